"""Messages as bytes: parts with their offsets, transfer encodings, and cleaning by splices."""

from __future__ import annotations

import base64
import quopri
import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from ..config import Config
from .engine import Engine
from .html import clean_html, clean_text
from .url import parse

PREFIX = "X-Mailsieve"


@dataclass
class Part:
    ctype: str
    charset: str
    encoding: str
    start: int
    end: int
    attachment: bool = False


@dataclass
class Outcome:
    cleaned: bytes
    headers: list[tuple[str, str]] = field(default_factory=list)
    html_parts: int = 0
    urls_cleaned: int = 0
    redirects_unwrapped: int = 0
    pixels_removed: int = 0
    pings_stripped: int = 0
    modified: bool = False
    mode: str = "enforce"
    policy: str = "default"
    error: str | None = None


BODY, FOLD, NEWLINE = re.compile(rb"\r?\n\r?\n"), re.compile(r"\r?\n[ \t]+"), re.compile(r"\r?\n")


def header_block(raw: bytes, start: int, end: int) -> tuple[list[tuple[str, str]], int]:
    """Unfolded headers, and where the body begins."""
    m = BODY.search(raw, start, end)
    if raw[start : start + 1] in (b"\n",) or raw[start : start + 2] == b"\r\n":
        return [], start + (1 if raw[start : start + 1] == b"\n" else 2)
    stop, body = (m.start(), m.end()) if m else (end, end)
    text = FOLD.sub(" ", raw[start:stop].decode("utf-8", "replace"))
    return [(k.strip(), v.strip()) for k, c, v in (line.partition(":") for line in NEWLINE.split(text)) if c], body


def header(headers, name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "")


def parameter(value: str, name: str) -> str:
    """A parameter of a structured header, also in extended form: continued (name*0, name*1) and encoded (name*)."""
    m = re.search(rf";\s*{name}\s*=\s*(?:\"([^\"]*)\"|([^;\s]*))", value, re.I)
    if m:
        return m[1] if m[1] is not None else m[2]
    pieces = re.findall(rf";\s*{name}(?:\*(\d+))?(\*)?\s*=\s*(?:\"([^\"]*)\"|([^;\s]*))", value, re.I)
    pieces.sort(key=lambda x: int(x[0] or 0))
    text = "".join(a or b for _, _, a, b in pieces)
    if any(mark for _, mark, _, _ in pieces):
        charset, quote, rest = text.partition("'")
        language, quote, rest = rest.partition("'") if quote else ("", "", "")
        text = unquote(rest if quote else text, charset or "utf-8" if quote else "utf-8", "replace")
    return text


def parts(raw: bytes, start: int = 0, end: int | None = None) -> list[Part]:
    """Leaf parts with the offsets of their bodies, in order, however deep they are nested."""
    out, todo = [], [(start, len(raw) if end is None else end)]
    while todo:
        start, end = todo.pop()
        headers, body = header_block(raw, start, end)
        ctype = header(headers, "content-type") or "text/plain"
        kind = ctype.split(";")[0].strip().lower()
        boundary = parameter(ctype, "boundary")
        if kind.startswith("multipart/") and boundary:
            marks = list(re.compile(rb"(?:^|\r?\n)--" + re.escape(boundary.encode()) + rb"(--)?[ \t]*(?=\r?\n|\Z)").finditer(raw, max(body - 1, 0), end))
            inner = []
            for i, m in enumerate(marks):
                if m[1]:
                    break
                a = m.end() + (2 if raw[m.end() : m.end() + 2] == b"\r\n" else 1)
                inner.append((a, marks[i + 1].start() if i + 1 < len(marks) else end))
            todo += [x for x in reversed(inner) if x[0] > start]
            continue
        disposition = header(headers, "content-disposition").split(";")[0].strip().lower()
        if kind == "message/rfc822" and disposition != "attachment" and body > start:
            todo.append((body, end))
            continue
        out.append(Part(kind, parameter(ctype, "charset").lower() or "utf-8", header(headers, "content-transfer-encoding").strip().lower() or "7bit", body, end, disposition == "attachment"))
    return out


def decoded(raw: bytes, p: Part) -> bytes:
    data = raw[p.start : p.end]
    if p.encoding == "base64":
        data = re.sub(rb"[^A-Za-z0-9+/]", b"", data)
        return base64.b64decode(data[: len(data) - (len(data) % 4 == 1)] + b"===")  # a single last character holds no byte
    return quopri.decodestring(data) if p.encoding == "quoted-printable" else data


def line_end(raw: bytes) -> bytes:
    i = raw.find(b"\n")
    return b"\r\n" if i > 0 and raw[i - 1 : i] == b"\r" else b"\n"


def quoted_printable(data: bytes, eol: bytes = b"\r\n") -> bytes:
    """At most 75 bytes a line and a soft break; line breaks are kept, white space at their ends encoded."""
    out = []
    for line in re.split(rb"\r\n|\n", data):
        pieces = [bytes([b]) if 33 <= b <= 126 and b != 61 or b in (32, 9) else b"=%02X" % b for b in line]
        if pieces and pieces[-1] in (b" ", b"\t"):
            pieces[-1] = b"=%02X" % pieces[-1][0]
        rows, now = [], b""
        for x in pieces:
            if len(now) + len(x) > 75:
                rows.append(now + b"=")
                now = b""
            now += x
        out.append(eol.join([*rows, now]))
    return eol.join(out)


def wrap64(data: bytes, eol: bytes) -> bytes:
    text = base64.b64encode(data)
    return eol.join(text[i : i + 76] for i in range(0, len(text), 76))


def encode_charset(text: str, charset: str) -> bytes | None:
    name = charset.lower()
    if name in ("utf-8", "utf8", "us-ascii", "ascii", ""):
        return text.encode("utf-8")
    if name in ("iso-8859-1", "latin1", "latin-1"):
        return text.encode("latin-1", "replace")
    if name.startswith("utf-16") or name.startswith("utf-32"):
        return text.encode() if text.isascii() else None
    try:
        return text.encode(name)
    except (LookupError, UnicodeError):
        return text.encode() if text.isascii() else None


def decode_charset(data: bytes, charset: str) -> str | None:
    try:
        return data.decode(charset or "utf-8")
    except (LookupError, UnicodeError):
        return None


def replacement(raw: bytes, p: Part, text: str, encoded: bool = True) -> bytes | None:
    """The body of a part for a new text in its charset and transfer encoding; None if it can't carry it."""
    data = encode_charset(text, p.charset)
    old = raw[p.start : p.end]
    if data is None:
        return None
    eol = line_end(raw)
    if not encoded or p.encoding not in ("base64", "quoted-printable"):
        if not data.isascii() and old.isascii():
            return None
        out = data
    else:
        out = wrap64(data, eol) if p.encoding == "base64" else quoted_printable(data, eol)
    tail = re.search(rb"(?:\r?\n)*\Z", old)[0]
    return re.sub(rb"(?:\r?\n)*\Z", b"", out) + tail


def sender_domain(headers) -> str | None:
    value = header(headers, "from")
    m = re.search(r"<([^>]*)>", value)
    address = (m[1] if m else value.split(",")[0]).strip()
    return address.rsplit("@", 1)[1].strip().rstrip(".").lower() or None if "@" in address else None


def unsubscribe_targets(headers) -> list[str]:
    return [t.strip() for t in re.findall(r"<([^>]*)>", header(headers, "list-unsubscribe")) if t.strip()]


def safe_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", text)


def clean_message(raw: bytes, engine: Engine) -> Outcome:
    config: Config = engine.config
    if len(raw) > config.max_message_size:
        raise ValueError("message too large")
    headers, body_at = header_block(raw, 0, len(raw))
    config, policy = config.for_sender(sender_domain(headers))
    engine = engine.with_config(config)
    targets = unsubscribe_targets(headers)
    protected = set(targets)
    out = Outcome(raw, mode=config.mode, policy=policy)
    oversized = mismatched = unencodable = 0
    splices: list[tuple[int, int, bytes]] = []

    def put(p: Part, text: str, encoded: bool = True) -> int:
        new = replacement(raw, p, text, encoded)
        if new is None:
            return 1
        if config.mode == "enforce":
            splices.append((p.start, p.end, new))
        return 0

    for p in parts(raw) if config.clean_html or config.clean_text_plain else ():
        if p.ctype == "text/html" and config.clean_html:
            data = decoded(raw, p)
            text, encoded = decode_charset(data, p.charset), True
            if (text is None or "<" not in text) and p.encoding in ("base64", "quoted-printable"):
                plain = decode_charset(raw[p.start : p.end], p.charset)  # declared encoding isn't the real one
                if plain is not None and "<" in plain:
                    text, encoded = plain, False
                    mismatched += 1
            if text is None:
                text = data.decode("utf-8", "replace")
            if p.attachment:
                continue
            out.html_parts += 1
            if len(data) > config.max_html_part_size:
                oversized += 1
                continue
            r = clean_html(text, engine, protected)
            for k in ("urls_cleaned", "redirects_unwrapped", "pixels_removed", "pings_stripped"):
                setattr(out, k, getattr(out, k) + getattr(r, k))
            if r.changed:
                unencodable += put(p, r.html, encoded)
        elif p.ctype == "text/plain" and config.clean_text_plain and not p.attachment:
            text = decode_charset(decoded(raw, p), p.charset)
            if text is not None:
                new, n = clean_text(text, engine)
                out.urls_cleaned += n
                if n:
                    unencodable += put(p, new)
    cleaned = raw
    for a, b, new in sorted(splices, reverse=True):
        cleaned = cleaned[:a] + new + cleaned[b:]
    out.modified = cleaned != raw
    h = [("Version", "1"), ("Mode", config.mode), ("Modified", "yes" if out.modified else "no"), ("Html-Parts", str(out.html_parts)), ("Urls-Cleaned", str(out.urls_cleaned)), ("Redirects-Unwrapped", str(out.redirects_unwrapped)), ("Pixels-Removed", str(out.pixels_removed)), ("Pings-Stripped", str(out.pings_stripped)), ("Policy", policy)]
    h += [(k, str(n)) for k, n in (("Skipped-Oversized-Parts", oversized), ("Cte-Mismatch-Parts", mismatched), ("Unencodable-Parts", unencodable)) if n]
    if config.surface_unsubscribe and targets:
        best = next((t for t in targets if t.lower().startswith(("http://", "https://"))), targets[0])
        url = parse(best)
        if url and url.web and not re.search(r"[\x00-\x1f\x7f-\x9f]", best):
            h.append(("Unsubscribe", str(url)))
    out.headers = [(f"{PREFIX}-{k}", safe_value(v)) for k, v in h]
    out.cleaned = with_headers(cleaned, out.headers)
    return out


def with_headers(raw: bytes, headers: list[tuple[str, str]]) -> bytes:
    """Headers inserted before the blank line that ends the block."""
    eol = line_end(raw)
    block = b"".join(f"{k}: {v}".encode() + eol for k, v in headers)
    m = re.search(rb"\r?\n(?=\r?\n)", raw)
    if raw[:1] == b"\n" or raw[:2] == b"\r\n":
        return block + raw
    if not m:
        return raw + (b"" if raw.endswith(b"\n") or not raw else eol) + block + eol
    return raw[: m.end()] + block + raw[m.end() :]


def clean_message_fail_open(raw: bytes, engine: Engine) -> Outcome:
    """Never raises: on an error the message passes unchanged with a header that says why."""
    try:
        return clean_message(raw, engine)
    except Exception as e:  # any malformed message must pass
        if not engine.config.fail_open:
            raise
        why = safe_value(str(e))[:120]
        headers = [(f"{PREFIX}-Version", "1"), (f"{PREFIX}-Error", why)]
        return Outcome(with_headers(raw, headers), headers, mode=engine.config.mode, error=why)
