"""Decisions on single URLs: which parameters go, where a wrapper leads, what is a beacon."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

from ..config import Config
from ..rules.packs import Param, Provider, Redirect, Ruleset, Scope
from .url import Url, canonical_link, decode_target, form_decode, from_base64, host_in, parse, percent_decode, registrable, reject_reason


INNER, AMPERSAND = re.compile("https?://"), re.compile("&(?:amp|AMP|#38|#[xX]26);")


@lru_cache(maxsize=100_000)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def glob_regex(glob: str) -> str:
    """'*' and '?' over the whole URL, upper and lower case alike."""
    return r"(?is)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + r"\Z"


def target_regex(target: str, match_case: bool = False) -> str:
    """'||' starts at a host label, '|' is an end, '^' a separator or the end, '*' anything."""
    head = tail = ""
    if target.startswith("||"):
        head, target = r"\A[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*[.@])?", target[2:]
    elif target.startswith("|"):
        head, target = r"\A", target[1:]
    if target.endswith("|"):
        target, tail = target[:-1], r"\Z"
    body = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in target)
    return ("(?s)" if match_case else "(?is)") + head + body + tail


def _literals(parsed) -> set[str] | None:
    """Of a parsed pattern, lower-case strings one of which is in every match; None if there are none of use."""
    best: set[str] | None = None
    run = ""
    for op, arg in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        found: set[str] | None = {run} if run else None
        run = ""
        if name == "SUBPATTERN":
            inner = _literals(arg[-1])
        elif name == "BRANCH":
            each = [_literals(x) for x in arg[1]]
            inner = set().union(*each) if all(each) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _literals(arg[2])
        else:
            inner = None
        for x in (found, inner):
            if x and (best is None or min(map(len, x)) > min(map(len, best))):
                best = x
    return best


@lru_cache(maxsize=100_000)
def needed(pattern: str) -> tuple[str, ...]:
    """Strings one of which a text must hold, in lower case, for the pattern to match; '' if nothing is known."""
    return tuple(sorted(_literals(re._parser.parse(pattern)) or {""}))


class Finder:
    """Which of many patterns match a text, in their order: a pattern is tried only if one of its strings is in the text."""

    def __init__(self, patterns):
        patterns = list(patterns)
        self.patterns = [compiled("(?i)" + p) for p in patterns]
        self.strings = [(x, i) for i, p in enumerate(patterns) for x in needed(p)]

    def every(self, text: str):
        low = text.lower()
        tried = range(len(self.patterns)) if not low.isascii() else sorted({i for x, i in self.strings if x in low})
        for i in tried:
            m = self.patterns[i].search(text)
            if m:
                yield i, m

    def first(self, text: str):
        return next(self.every(text), (None, None))


@dataclass
class Cleaned:
    url: str
    changed: bool
    removed: list[str]


@dataclass
class Unwrapped:
    url: str
    original: str
    unwrapped: bool
    provider: str | None = None
    rejected: str | None = None


class Engine:
    """A ruleset and a configuration, applied to one URL at a time.  Small enough to go into a closure."""

    def __init__(self, rules: Ruleset, config: Config = Config()):
        self.rules, self.config = rules, config

    def with_config(self, config: Config) -> Engine:
        out = Engine(self.rules, config)
        out.by_name, out.by_param, out.finders = self.by_name, self.by_param, self.finders  # they don't depend on the configuration
        return out

    @cached_property
    def by_name(self) -> dict[str, Provider]:
        return {p.name: p for p in self.rules.providers}

    def in_scope(self, s: Scope, text: str, host: str) -> bool:
        if s.kind == "regex":
            return bool(compiled("(?i)" + s.pattern).search(text))
        if s.kind == "glob":
            return bool(compiled(glob_regex(s.pattern)).match(text))
        if s.kind == "target":
            return (not s.domains or host_in(host, s.domains)) and bool(compiled(target_regex(s.pattern, s.match_case)).search(text))
        return True

    def scoped(self, include, exclude, text: str, host: str) -> bool:
        return (not include or any(self.in_scope(s, text, host) for s in include)) and not any(self.in_scope(s, text, host) for s in exclude)

    @cached_property
    def finders(self) -> dict[str, tuple[list, Finder]]:
        """Providers but the global one, those with exceptions, beacons, and pattern redirects, each with their patterns."""
        every = self.rules.providers
        groups = {"provider": [p for p in every if not p.is_global], "excepting": [p for p in every if p.exceptions], "beacon": [p for p in every if p.complete], "redirect": [r for r in self.rules.redirects if r.kind == "pattern"]}
        return {k: (v, Finder(x.pattern for x in v)) for k, v in groups.items()}

    def __getstate__(self) -> dict:
        return {"rules": self.rules, "config": self.config}

    def provider(self, text: str) -> str | None:
        """The first provider other than the global one whose pattern matches."""
        those, finder = self.finders["provider"]
        i, _ = finder.first(text)
        return None if i is None else those[i].name

    def excepted(self, name: str, text: str) -> bool:
        p = self.by_name.get(name)
        return bool(p) and any(compiled("(?i)" + e).search(text) for e in p.exceptions)

    @cached_property
    def by_param(self) -> tuple[dict[str, list[int]], list[tuple[str, int]], list[int]]:
        """Rules by their plain name, by a prefix of it, and those that need a test of their own."""
        exact: dict[str, list[int]] = {}
        starts, rest = [], []
        for i, (p, _) in enumerate(self.rules.params):
            plain = p.matcher.subject == "decoded-name" and not p.exception_all and not p.matcher.needs_equals and not p.matcher.case
            if plain and p.matcher.kind == "exact":
                exact.setdefault(p.matcher.value.lower(), []).append(i)
            elif plain and p.matcher.kind == "prefix":
                starts.append((p.matcher.value.lower(), i))
            else:
                rest.append(i)
        return exact, starts, rest

    def context(self, url: Url):
        """A test of whether a rule is in force for a URL; scopes are tested once and when needed."""
        text, host = str(url), (url.host or "").lower()
        those, finder = self.finders["excepting"]
        hit = {those[k].name for k, _ in finder.every(text) if self.excepted(those[k].name, text)} if those else set()
        seen: dict[tuple, bool] = {}

        def active(i: int) -> bool:
            p, names = self.rules.params[i]
            if p.source == "clear-urls":
                if (p.referral and not self.config.strip_referral_marketing) or (not p.is_global and not self.config.apply_vendor_rules):
                    return False
                if hit and (p.is_global or (names and names <= hit)):
                    return False
            key = (p.include, p.exclude)
            if key not in seen:
                seen[key] = self.scoped(p.include, p.exclude, text, host)
            return seen[key]

        return active

    @staticmethod
    def matches(p: Param, raw: str, equals: bool, name: str, pair: str) -> bool:
        m = p.matcher
        if m.needs_equals and not equals:
            return False
        subject = raw if m.subject == "raw-name" else pair if m.subject == "decoded-pair" else name
        if m.kind == "regex":
            return bool(compiled(m.value).search(subject))
        value = m.value
        if not m.case:
            subject, value = subject.lower(), value.lower()
        return subject == value if m.kind == "exact" else subject.startswith(value)

    def param_is_tracking(self, url: Url, name: str) -> bool:
        """Whether a parameter of this name goes from the URL, as it is or with an equals sign."""
        active = self.context(url)
        return any(self.removes(active, s) is not None for s in (name, name + "="))

    @staticmethod
    def listed(name: str, patterns) -> bool:
        if not patterns:
            return False
        name = name.lower()
        return any(name.startswith(p[:-1].lower()) if p.endswith("*") and len(p) > 1 else name == p.lower() for p in patterns)

    def removes(self, active, segment: str) -> str | None:
        """The decoded name if the segment goes."""
        raw, equals, value = segment.partition("=")
        name = form_decode(raw)
        if self.listed(name, self.config.keep_params):
            return None
        if self.listed(name, self.config.extra_tracking_params):
            return name
        exact, starts, rest = self.by_param
        low, rules = name.lower(), self.rules.params
        found = [*exact.get(low, ()), *(i for x, i in starts if low.startswith(x))]
        if rest:
            pair = f"{name}={form_decode(value)}"
            found += [i for i in rest if (p := rules[i][0]).exception_all or self.matches(p, raw, bool(equals), name, pair)]
        hits = [rules[i][0] for i in found if active(i)]
        if not hits:
            return None
        spared = {p.matcher for p in hits if p.exception}
        every = any(p.exception_all for p in hits)
        return name if any(not p.exception and not p.exception_all and not (p.source == "ad-guard" and (every or p.matcher in spared)) for p in hits) else None

    def clean(self, url: Url) -> Cleaned:
        if not url.query or host_in(url.host, self.config.exclude_domains):
            return Cleaned(str(url), False, [])
        active, kept, removed = self.context(url), [], []
        for s in url.query.split("&"):
            name = self.removes(active, s) if s else None
            if name is None:
                kept.append(s)
            else:
                removed.append(name)
        if not removed:
            return Cleaned(str(url), False, [])
        return Cleaned(str(url.with_query("&".join(s for s in kept if s) or None)), True, removed)

    def extract(self, r: Redirect, url: Url, text: str) -> str | None:
        if r.kind == "query":
            values = {v for k, eq, v in (s.partition("=") for s in (url.query or "").split("&")) if eq and k in r.names}
            value = values.pop() if len(values) == 1 else None
            if value and r.decode == "base64":
                value = from_base64(percent_decode(value), 8)
        else:
            m = compiled(r.pattern).search(url.path)
            groups = m.groups() if m else ()
            if not m or any(g is None for g in groups):
                return None
            value = "".join(groups) if r.template is None else re.sub(r"\$([1-9])", lambda k: groups[int(k[1]) - 1], r.template)
        if value and r.prepend:
            if parse(value):
                return None
            value = f"{r.prepend}://{percent_decode(value)}"
            return value if parse(value) else None
        return value

    def target(self, url: Url) -> tuple[Redirect, str] | None:
        text, host = str(url), (url.host or "").rstrip(".").lower()
        those, finder = self.finders["redirect"]
        hits = ((those[i], m[1]) for i, m in finder.every(text))
        if len(those) == len(self.rules.redirects):
            return next((x for x in hits if x[1]), None)
        matched = {id(r): found for r, found in hits}
        for r in self.rules.redirects:
            if r.kind == "pattern":
                found = matched.get(id(r))
            else:
                found = self.extract(r, url, text) if self.scoped(r.include, r.exclude, text, host) else None
            if found:
                return r, found
        return None

    def unwrap(self, url: Url) -> Unwrapped:
        text = str(url)
        if host_in(url.host, self.config.exclude_domains):
            return Unwrapped(text, text, False)
        provider = self.provider(text)
        found = self.target(url)
        if found:
            rule, candidate = found
            goal = decode_target(candidate)
            if goal is not None:
                reason = reject_reason(goal)
                if reason is None and rule.kind != "pattern":
                    own = registrable(goal.host or "")
                    if own is None or goal.host == url.host or own == registrable(url.host or ""):
                        reason = "brave-destination-scope"
                if reason:
                    return Unwrapped(self.clean(url).url, text, False, rule.provider or provider, reason)
                return Unwrapped(self.clean(goal).url, text, True, rule.provider or provider)
        return Unwrapped(self.clean(url).url, text, False, provider)

    def raw_rules(self, text: str) -> str:
        """Raw rules of matching providers, one after another on the result so far."""
        out = text
        for r in self.rules.raws:
            if compiled("(?i)" + self.by_name[r.provider].pattern).search(text):
                out = compiled("(?i)" + r.pattern).sub("", out)
        return out

    def beacon(self, text: str) -> bool:
        """An image URL of a tracking host, also when embedded in another URL."""
        url = parse(text)
        if url and host_in(url.host, self.config.extra_pixel_domains):
            return True

        def known(t: str, host: str) -> bool:
            return self.finders["beacon"][1].first(t)[0] is not None or any(self.scoped(a, b, t, host) for a, b in self.rules.beacons)

        if url and known(str(url), url.host or ""):
            return True
        decoded = percent_decode(text)
        inner = [m.start() for m in INNER.finditer(decoded) if m.start()]
        if not inner:
            return False if url else bool(re.match(r"[\w.-]+$", text)) and known(f"https://{text}/", text)
        return any(known(decoded[i:], (parse(decoded[i:]) or Url("")).host or "") for i in inner)

    def link(self, href: str, sensitive: set[str] = frozenset(), base: Url | None = None) -> tuple[str | None, str]:
        """(new href or None, verdict: skip, sensitive, blocked, unwrap, rejected, clean or unchanged)."""
        text = AMPERSAND.sub("&", href.strip())
        if not text or text.startswith("#"):
            return None, "skip"
        url = parse(text, base)
        if url is None or not url.web:
            return None, "skip"
        if sensitive and (text in sensitive or str(url) in sensitive or canonical_link(str(url)) in {canonical_link(s) for s in sensitive}):
            return None, "sensitive"
        if host_in(url.host, self.config.blocked_domains):
            return "about:blank", "blocked"
        if self.config.unwrap_known_redirects:
            got = self.unwrap(url)
            goal = parse(got.url)
            if goal and host_in(goal.host, self.config.blocked_domains):
                return "about:blank", "blocked"
            if got.unwrapped:
                return got.url, "unwrap"
            if got.url != str(url):
                return got.url, "clean"
            return None, f"rejected:{got.rejected}" if got.rejected else "unchanged"
        done = self.clean(url)
        return (done.url, "clean") if done.changed else (None, "unchanged")
