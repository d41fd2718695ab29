"""Links, pixels and style beacons of HTML, rewritten in place: bytes that aren't changed stay as they are."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .engine import Engine
from .url import parse

# an element whose content is text is one token: tags inside are none
ATTRS = r"""((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)"""
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)" + ATTRS + ">", re.S | re.I)
ATTR = re.compile(r"""([^\s"'<>/=]+)(\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
CSS_URL = re.compile(r"""url\(\s*(?:"([^"]*)"|'([^']*)'|([^)"']*))\s*\)""", re.I)
MARKED = re.compile("style|background", re.I)
EXTENSIONS = "gif|png|jpg|jpeg|webp|bmp"
# Path parts of open trackers, and names of layout images.
NEEDLES = "/open /pixel /track /beacon /spy /o.gif /open.gif /wf/open /wf/o /email-open /openrate".split()
LAYOUT = "logo icon avatar header footer banner hero".split()


@dataclass
class Result:
    html: str
    changed: bool = False
    urls_cleaned: int = 0
    redirects_unwrapped: int = 0
    pixels_removed: int = 0
    pings_stripped: int = 0
    removed: list[str] = field(default_factory=list)


def dimension(text: str | None) -> int | None:
    m = re.match(r"\s*(\d+)\s*(.?)", text or "", re.S)
    return None if not m or m[2] == "%" else int(m[1])


def style_facts(style: str) -> tuple[bool, int | None, int | None]:
    """(hidden, width, height); the last width and height count."""
    hidden, size = False, {"width": None, "height": None}
    for part in re.sub(r"\s+", "", style).lower().split(";"):
        key, _, value = part.partition(":")
        if (key, value) in (("display", "none"), ("visibility", "hidden")):
            hidden = True
        elif key == "opacity":
            try:
                hidden = hidden or float(value) <= 0
            except ValueError:
                pass
        elif key in size and (n := dimension(value)) is not None:
            size[key] = n
    return hidden, size["width"], size["height"]


def pixel_path(src: str) -> bool:
    url = parse(src.lower())
    return bool(url) and (bool(re.fullmatch(rf"[a-z0-9]{{0,2}}\.(?:{EXTENSIONS})", url.path.rsplit("/", 1)[-1])) or any(n in url.path for n in NEEDLES))


def is_pixel(attrs: dict[str, str], engine: Engine) -> bool:
    src = attrs.get("src", "").strip()
    url = parse(src)
    if not url or not url.web:
        return False
    hidden, sw, sh = style_facts(attrs.get("style", ""))
    if engine.beacon(src) or hidden:
        return True
    w, h = dimension(attrs.get("width")), dimension(attrs.get("height"))
    w, h = sw if w is None else w, sh if h is None else h
    if attrs.get("alt", "").strip():
        return False
    given = [d for d in (w, h) if d is not None]
    if given:
        return max(given) <= 2
    hint = attrs.get("role", "").lower() == "presentation" or any(n in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower() for n in LAYOUT)
    return not hint and pixel_path(src)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), next((g for g in m.groups()[2:] if g is not None), ""))
    return out


def links(html: str) -> list[str]:
    """The href of every a and area, in page order."""
    return [a["href"] for m in TAG.finditer(html) if m[3] and not m[2] and m[3].lower() in ("a", "area") and "href" in (a := attributes(m[4]))]


def clean_html(html: str, engine: Engine, sensitive: set[str] = frozenset(), base_url: str | None = None) -> Result:
    c = engine.config
    out = Result(html)
    if 4 * len(html) > c.max_html_part_size and len(html.encode("utf-8", "replace")) > c.max_html_part_size:
        return out
    base = parse(base_url) if base_url else None
    rewrites_links = c.clean_query_params or c.unwrap_known_redirects or bool(c.blocked_domains)
    css = c.remove_pixels and c.neutralize_css_beacons

    def quiet(attrs: dict[str, str]):
        hidden, w, h = style_facts(attrs.get("style", ""))
        w, h = (dimension(attrs.get(k)) if dimension(attrs.get(k)) is not None else x for k, x in (("width", w), ("height", h)))
        unseen = hidden or any(d is not None and d <= 2 for d in (w, h))

        def swap(m: re.Match) -> str:
            target = next(g for g in m.groups() if g is not None).strip()
            url = parse(target)
            if url and url.web and (unseen or engine.beacon(target)):
                out.pixels_removed += 1
                return "none"
            return m[0]

        return swap

    def element(m: re.Match) -> str:
        if m[3] is None or m[2]:
            return m[0]
        tag = m[3].lower()
        if tag not in ("img", "a", "area") and not (css and MARKED.search(m[4])):
            return m[0]
        attrs = attributes(m[4])
        if tag == "img" and c.remove_pixels and is_pixel(attrs, engine):
            out.pixels_removed += 1
            out.removed.append(attrs.get("src", ""))
            safe = attrs.get("src", "").replace("--", "- -").replace(">", "&gt;").replace("<", "&lt;")
            return f"<!-- removed: {safe} -->" if c.debug_preserve_removed else ""
        edits: dict[str, str | None] = {}
        extra = ""
        if tag in ("a", "area"):
            if rewrites_links and "href" in attrs:
                new, verdict = engine.link(attrs["href"], sensitive, base)
                if new is not None:
                    edits["href"] = new
                    if verdict == "unwrap":
                        out.redirects_unwrapped += 1
                    else:
                        out.urls_cleaned += 1
                    if c.preserve_original_href:
                        extra = f' data-original-href="{attrs["href"].replace(chr(34), "&quot;")}"'
            if c.strip_link_ping and "ping" in attrs:
                edits["ping"] = None
                out.pings_stripped += 1
        if css and "style" in attrs and "url(" in attrs["style"].lower():
            new = CSS_URL.sub(quiet(attrs), attrs["style"])
            if new != attrs["style"]:
                edits["style"] = new
        if css and "background" in attrs and (url := parse(attrs["background"])) and url.web and engine.beacon(attrs["background"]):
            edits["background"] = None
            out.pixels_removed += 1
        if not edits:
            return m[0]
        done: set[str] = set()

        def attribute(a: re.Match) -> str:
            key = a[1].lower()
            if key not in edits or key in done:
                return a[0]
            done.add(key)
            value = edits[key]
            return "" if value is None else f'{a[1]}="{value.replace(chr(34), "&quot;")}"'

        return f"<{m[3]}{ATTR.sub(attribute, m[4])}{extra}>"

    out.html = TAG.sub(element, html)
    out.changed = bool(out.urls_cleaned + out.redirects_unwrapped + out.pixels_removed + out.pings_stripped)
    return out


TEXT_URL = re.compile(r"https?://[^\s<>\"')\]]*", re.I)


def clean_text(text: str, engine: Engine) -> tuple[str, int]:
    """Plain text with its URLs cleaned (not unwrapped), and how many changed."""
    n = 0

    def swap(m: re.Match) -> str:
        nonlocal n
        body = m[0].rstrip(".,;:!?")
        url = parse(body)
        done = engine.clean(url) if url else None
        if not done or not done.changed:
            return m[0]
        n += 1
        return done.url + m[0][len(body) :]

    return TEXT_URL.sub(swap, text), n
