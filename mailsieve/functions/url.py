"""URLs as values: parsing to a normal form, decoding, and checks of redirect targets."""

from __future__ import annotations

import base64
import ipaddress
import json
import re
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from urllib.parse import unquote_to_bytes

PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):(.*)", re.S)
BLANK = "".join(map(chr, range(33)))
BREAKS = re.compile(r"[\t\r\n]")
HOST_PORT = re.compile(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?")
BAD_HOST = re.compile(r"[\x00-\x20\x7f\"#%/:<>?@\[\\\]^`{|}]")


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str | None = None
    host: str | None = None
    port: str | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None

    @property
    def web(self) -> bool:
        return self.scheme in ("http", "https")

    def __str__(self) -> str:
        return self.text

    @cached_property
    def text(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (f"{self.user}@" if self.user else "") + self.host + (f":{self.port}" if self.port else "")
        out += self.path
        return out + ("" if self.query is None else "?" + self.query) + ("" if self.fragment is None else "#" + self.fragment)

    def with_query(self, query: str | None) -> Url:
        return replace(self, query=query)


@lru_cache(maxsize=None)
def _odd(extra: str) -> re.Pattern:
    return re.compile(f"[^!-~]|[{re.escape(extra)}]" if extra else "[^!-~]")


def _escape(text: str, extra: str) -> str:
    if not _odd(extra).search(text):
        return text
    return "".join(c if " " < c < "\x7f" and c not in extra else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4(host: str) -> str | None | bool:
    """The dotted form if the host is a number form, None if it is a bad one, False if it is none."""
    parts = host.rstrip(".").split(".") if host.endswith(".") else host.split(".")
    if not re.fullmatch(r"\d+|0[xX][0-9a-fA-F]*", parts[-1]):
        return False
    numbers = []
    for p in parts:
        m = re.fullmatch(r"0[xX]([0-9a-fA-F]*)|0([0-7]*)|(\d+)", p)
        if not m:
            return None
        numbers.append(int(m[1] or "0", 16) if m[1] is not None else int(m[2] or "0", 8) if m[2] is not None else int(m[3]))
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


@lru_cache(maxsize=100_000)
def _host(raw: str) -> str | None:
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") and "%" not in raw else None
        except ValueError:
            return None
    host = unquote_to_bytes(raw).decode("utf-8", "replace")
    try:
        host = host.lower() if host.isascii() else host.lower().encode("idna").decode()
    except UnicodeError:
        return None
    if not host or BAD_HOST.search(host):
        return None
    number = _ipv4(host)
    return host if number is False else number


def _dots(path: str) -> str:
    if "/." not in path and "%" not in path:
        return path
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            out = out[:-1]
        elif low != ".":
            out.append(p)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """The URL in normal form, or None.  Relative references need ``base``."""
    if text is None:
        return None
    text = BREAKS.sub("", text.strip(BLANK))
    m = SCHEME.fullmatch(text)
    if not m or (base and base.web and m[1].lower() == base.scheme and not m[2].startswith(("/", "\\"))):
        return _join(base, m[2] if m else text) if base else None
    scheme, rest = m[1].lower(), m[2]
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    web = scheme in PORTS
    end = {"query": _escape(query, "\"<>'" if web else '"<>') if mark else None, "fragment": _escape(fragment, '"<>`') if hash_ else None}
    if not web:
        if not rest.startswith("//"):
            return Url(scheme, path=_escape(rest, "").replace("%20", " ") if not rest.startswith("/") else _dots(_escape(rest, '"<>`{}')), **end)
        authority, slash, path = rest[2:].partition("/")
        return Url(scheme, host=authority, path=_escape(slash + path, '"<>`{}'), **end)
    rest = rest.replace("\\", "/").lstrip("/")
    authority, slash, path = rest.partition("/")
    user, at, host = authority.rpartition("@")
    h = HOST_PORT.fullmatch(host)
    name = _host(h[1]) if h else None
    if name is None or (h[2] and int(h[2]) > 65535):
        return None
    port = str(int(h[2])) if h[2] else None
    return Url(scheme, _escape(user, '"<>`{}/;=@[]^|') if at and user not in ("", ":") else None, name, None if port == PORTS[scheme] else port, _dots("/" + _escape(path, '"<>`{}^')), **end)


def _join(base: Url, ref: str) -> Url | None:
    ref, hash_, fragment = ref.replace("\\", "/").partition("#")
    tail = _escape(fragment, '"<>`') if hash_ else None
    if ref.startswith("//"):
        return parse(f"{base.scheme}:{ref}" + (f"#{fragment}" if hash_ else ""))
    path, mark, query = ref.partition("?")
    q = _escape(query, "\"<>'") if mark else None
    if not path:
        return replace(base, query=q if mark else base.query, fragment=tail)
    whole = path if path.startswith("/") else base.path[: base.path.rfind("/") + 1] + path
    return replace(base, path=_dots(_escape(whole, '"<>`{}^')), query=q, fragment=tail)


def form_decode(text: str) -> str:
    if "%" not in text and "+" not in text:
        return text
    return unquote_to_bytes(text.replace("+", " ")).decode("utf-8", "replace")


def percent_decode(text: str) -> str:
    return text if "%" not in text else unquote_to_bytes(text).decode("utf-8", "replace")


def host_in(host: str | None, domains) -> bool:
    """The host is one of the domains or below one."""
    if not host:
        return False
    host = host.lower()
    return any(host == d or host.endswith("." + d) for d in domains)


def from_base64(text: str, least: int = 16) -> str | None:
    """A URL from base64 text: the text itself, or href or url of a JSON object."""
    body = text.rstrip("=")
    if len(body) < least or not (re.fullmatch(r"[A-Za-z0-9_-]+", body) or re.fullmatch(r"[A-Za-z0-9+/]+", body)):
        return None
    try:
        out = base64.b64decode(body.translate(str.maketrans("-_", "+/")) + "=" * (-len(body) % 4), validate=True).decode("utf-8").strip()
    except ValueError:
        return None
    if parse(out):
        return out
    try:
        value = json.loads(out)
    except ValueError:
        return None
    for key in ("href", "url"):
        if isinstance(value, dict) and isinstance(value.get(key), str) and parse(value[key]):
            return value[key]
    return None


def decode_target(text: str) -> Url | None:
    """A redirect candidate: as it is, percent-decoded up to three times, then base64."""
    now = text
    for _ in range(4):
        url = parse(now)
        if url:
            return url
        after = percent_decode(now)
        if after == now:
            break
        now = after
    found = from_base64(text) or from_base64(percent_decode(text))
    return parse(found) if found else None


#: Networks that are no public addresses.
BLOCKED = [ipaddress.ip_network(n) for n in "0.0.0.0/32 127.0.0.0/8 10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 169.254.0.0/16 255.255.255.255/32 192.0.2.0/24 198.51.100.0/24 203.0.113.0/24 100.64.0.0/10 198.18.0.0/15 192.0.0.0/24 224.0.0.0/4 240.0.0.0/4".split()]


@lru_cache(maxsize=100_000)
def blocked_ip(host: str) -> bool:
    """Addresses that aren't of the public internet."""
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    if ip.version == 6:
        if ip.is_loopback or ip.is_unspecified or ip.is_multicast:
            return True
        if ip.ipv4_mapped:
            return blocked_ip(str(ip.ipv4_mapped))
        n = int(ip)
        if n >> 32 == 0:
            return blocked_ip(str(ipaddress.IPv4Address(n & 0xFFFFFFFF)))
        return n >> 121 == 0xFC >> 1 or n >> 118 == 0xFE80 >> 6
    return any(ip in net for net in BLOCKED)


def mixed_script(host: str) -> bool:
    """A label with both Latin and other letters."""
    latin = lambda c: c.isalpha() and (c.isascii() or "À" <= c <= "ɏ")
    return any(any(map(latin, label)) and any(c.isalpha() and not latin(c) for c in label) for label in host.split("."))


def reject_reason(url: Url) -> str | None:
    """Why a redirect target is not taken, by the first check that fails."""
    if not url.web:
        return f"bad-scheme:{url.scheme}"
    if url.user:
        return "userinfo"
    if re.search(r"[\x00-\x1f\x7f-\x9f]", str(url)):
        return "control-chars"
    if not url.host:
        return "invalid-host"
    if mixed_script(url.host):
        return "mixed-script"
    return "private-ip" if blocked_ip(url.host) else None


#: Second-level names under which country registries register, and suffixes of private registries.
SECOND_LEVEL = frozenset("ac biz co com ed edu go gob gouv gov gv id info ltd me mil muni ne net nom or org plc res sch web".split())
PRIVATE_SUFFIXES = frozenset("github.io gitlab.io herokuapp.com appspot.com blogspot.com cloudfront.net netlify.app vercel.app web.app azurewebsites.net pages.dev workers.dev firebaseapp.com s3.amazonaws.com".split())


class Suffixes:
    """Public suffixes: by rule, or by the rules of a list in the public format if one is given.

    By rule a suffix is the last label, and with it the label before if that is a common second-level name
    under a country's two letters, so a.co.kr and b.co.kr are two sites.  A list adds its own rules,
    wildcards and exceptions; what follows its line '===BEGIN PRIVATE DOMAINS===' is private.
    """

    def __init__(self, text: str = ""):
        self.public: set[str] = set()
        self.private = set(PRIVATE_SUFFIXES)
        into = self.public
        for line in text.splitlines():
            if "===BEGIN PRIVATE DOMAINS===" in line:
                into = self.private
            elif line.strip() and not line.startswith("//"):
                into.add(line.split()[0].lower())

    def of(self, labels: list[str]) -> tuple[int, bool]:
        """(number of labels of the suffix, whether it is private); the longest rule counts, exceptions first."""
        best, private = 1, False
        if len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL and not self.public:
            best = 2
        for n in range(1, len(labels) + 1):
            tail = ".".join(labels[-n:])
            wild = ".".join(["*", *labels[-n:][1:]])
            for rules in (self.public, self.private):
                if "!" + tail in rules:
                    return n - 1, rules is self.private
                if tail in rules or (n > 1 and wild in rules):
                    best, private = n, rules is self.private
        return best, private


RULE = Suffixes()


def registrable(host: str, suffixes: Suffixes = RULE) -> str | None:
    """The public suffix and one label more; none for addresses, for a suffix itself and below private suffixes."""
    host = host.lower().rstrip(".")
    labels = host.split(".")
    if host.startswith("[") or labels[-1].isdigit():
        return None
    n, private = suffixes.of(labels)
    return None if private or len(labels) <= n else ".".join(labels[-n - 1 :])


@lru_cache(maxsize=100_000)
def canonical_link(text: str) -> str:
    """Scheme, host, decoded path and sorted decoded pairs, for comparing links."""
    url = parse(text)
    if not url or not url.web:
        return text.strip()
    pairs = sorted("=".join(map(form_decode, s.partition("=")[::2])) for s in (url.query or "").split("&") if s)
    return f"{url.scheme}://{url.host}{percent_decode(url.path)}" + ("?" + "&".join(pairs) if pairs else "")
