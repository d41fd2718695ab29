"""Rule packs: four syntaxes become one list of rules, checked against budgets and deduplicated.

A pack is small, bounded configuration, so it is compiled on the driver; what it compiles to is
applied by column expressions, broadcast joins or Arrow functions.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from . import builtin

PATTERN_BYTES, EXPAND, GLOBAL = 64 * 1024, 64, "globalRules"
LOOKAROUND = re.compile(r"\(\?(?:=|!|<=|<!)|\\[1-9]")


@dataclass(frozen=True)
class Limits:
    source_bytes: int = 5 << 20
    total_bytes: int = 25 << 20
    sources: int = 32
    rules: int = 50_000
    regexes: int = 10_000
    samples: int = 16


@dataclass(frozen=True)
class Scope:
    kind: str  # any, regex, glob or target
    pattern: str = ""
    domains: tuple[str, ...] = ()
    match_case: bool = False


@dataclass(frozen=True)
class Matcher:
    kind: str  # exact, prefix or regex
    value: str
    subject: str = "decoded-name"  # or raw-name, decoded-pair
    case: bool = False
    needs_equals: bool = False


@dataclass(frozen=True)
class Param:
    source: str  # clear-urls, brave or ad-guard
    matcher: Matcher
    provider: str | None = None
    is_global: bool = False
    referral: bool = False
    exception: bool = False
    exception_all: bool = False
    include: tuple[Scope, ...] = ()
    exclude: tuple[Scope, ...] = ()


@dataclass(frozen=True)
class Provider:
    name: str
    pattern: str
    is_global: bool = False
    complete: bool = False
    exceptions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Redirect:
    kind: str  # pattern, query or path
    pattern: str = ""
    provider: str | None = None
    names: tuple[str, ...] = ()
    decode: str = ""
    template: str | None = None
    prepend: str = ""
    include: tuple[Scope, ...] = ()
    exclude: tuple[Scope, ...] = ()


@dataclass(frozen=True)
class Raw:
    pattern: str
    provider: str


@dataclass
class Report:
    source: str
    format: str = ""
    loaded: int = 0
    duplicates: int = 0
    unsupported: int = 0
    failed: int = 0
    error: str | None = None
    samples: list[str] = field(default_factory=list)

    def skip(self, kind: str, what: str, limit: int) -> None:
        setattr(self, kind, getattr(self, kind) + 1)
        if len(self.samples) < min(limit, 16):
            self.samples.append(f"{kind}: {what[:120]}")


@dataclass
class Source:
    providers: list[Provider] = field(default_factory=list)
    params: list[Param] = field(default_factory=list)
    redirects: list[Redirect] = field(default_factory=list)
    beacons: list[tuple[tuple[Scope, ...], tuple[Scope, ...]]] = field(default_factory=list)
    raws: list[Raw] = field(default_factory=list)

    def rules(self) -> int:
        return len(self.params) + len(self.redirects) + len(self.beacons) + len(self.raws) + len(self.providers)

    def regexes(self) -> int:
        """Distinct expressions that need a regular expression."""
        every: set = {("provider", p.pattern) for p in self.providers} | {("exception", e) for p in self.providers for e in p.exceptions}
        every |= {("param", p.matcher) for p in self.params if p.matcher.kind == "regex"}
        every |= {("redirect", r.pattern) for r in self.redirects if r.pattern} | {("raw", r.pattern) for r in self.raws}
        groups = itertools.chain(((p.include, p.exclude) for p in self.params), ((r.include, r.exclude) for r in self.redirects), self.beacons)
        return len(every | {("scope", s) for pair in groups for s in itertools.chain(*pair) if s.kind != "any"})


def compiles(pattern: str) -> bool:
    """A pattern that any engine without backtracking would take, within the size limit."""
    if len(pattern.encode()) > PATTERN_BYTES or LOOKAROUND.search(pattern):
        return False
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def detect(text: str) -> str | None:
    head = text.lstrip("﻿ \t\r\n")
    if head[:1] in ("{", "["):
        try:
            value = json.loads(head)
        except ValueError:
            return None if head[0] == "[" else "ad-guard"
        if isinstance(value, dict):
            return "clear-urls" if isinstance(value.get("providers"), dict) else "ad-guard"
        if any(isinstance(x, dict) and "action" in x for x in value):
            return "brave-debounce"
        return "brave-clean-urls" if any(isinstance(x, dict) and "params" in x for x in value) else None
    return "ad-guard"


def expansions(pattern: str) -> list[str] | None:
    """The strings of a pattern of literals, alternation and fixed repetition (up to 8 times), if there are at most EXPAND; None for any other."""

    def of(parsed) -> list[str] | None:
        now = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "AT":
                continue
            if name == "LITERAL":
                piece = [chr(arg)]
            elif name == "IN" and len(arg) == 1 and str(arg[0][0]) == "LITERAL":
                piece = [chr(arg[0][1])]
            elif name == "SUBPATTERN":
                piece = of(arg[-1])
            elif name == "BRANCH":
                each = [of(x) for x in arg[1]]
                piece = None if None in each else [x for part in each for x in part]
            elif name == "MAX_REPEAT" and arg[0] == arg[1] <= 8:
                once = of(arg[2])
                piece = None if once is None or len(once) ** arg[1] > EXPAND else ["".join(x) for x in itertools.product(once, repeat=arg[1])]
            else:
                return None
            if piece is None:
                return None
            now = list(dict.fromkeys(a + b for a in now for b in piece))
            if len(now) > EXPAND:
                return None
        return now

    found = of(re._parser.parse(pattern))
    return None if found is None else sorted(set(found) - {""})


def literal_prefix(pattern: str) -> str | None:
    """What stands before a final '.*' if that is all literal."""
    parsed = [x for x in re._parser.parse(pattern) if str(x[0]) != "AT"]
    if not parsed or str(parsed[-1][0]) != "MAX_REPEAT" or any(str(op) != "LITERAL" for op, _ in parsed[:-1]):
        return None
    least, most, inner = parsed[-1][1]
    any_number = least == 0 and most == re._parser.MAXREPEAT and [str(op) for op, _ in inner] == ["ANY"]
    return "".join(chr(c) for _, c in parsed[:-1]) if any_number else None


def normalise(pattern: str) -> list[Matcher] | None:
    """A parameter pattern as exact names, a prefix or else a regular expression over the whole name."""
    if not pattern or not compiles(pattern):
        return None
    if prefix := literal_prefix(pattern):
        return [Matcher("prefix", prefix.lower())]
    every = expansions(pattern)
    if every and all(x.isascii() for x in every):
        return [Matcher("exact", x) for x in sorted({x.lower() for x in every})]
    return [Matcher("regex", f"(?i)^(?:{pattern})$")]


def clear_urls(text: str, report: Report, limits: Limits) -> Source:
    out = Source()
    for name, p in sorted(json.loads(text)["providers"].items(), key=lambda x: x[0].encode()):
        pattern = p.get("urlPattern", "")
        if not compiles(pattern):
            report.skip("failed", f"provider {name}", limits.samples)
            continue
        exceptions = tuple(p.get("exceptions", ()))
        if not all(map(compiles, exceptions)):
            raise ValueError(f"bad exception of {name}")
        is_global = name == GLOBAL
        out.providers.append(Provider(name, pattern, is_global, bool(p.get("completeProvider")), exceptions))
        for key, referral in (("rules", False), ("referralMarketing", True)):
            for rule in p.get(key, ()):
                matchers = normalise(rule)
                if matchers is None:
                    report.skip("failed", rule, limits.samples)
                for m in matchers or ():
                    out.params.append(Param("clear-urls", m, name, is_global, referral, include=() if is_global else (Scope("regex", pattern),)))
        for rule in p.get("redirections", ()):
            if compiles(rule) and re.compile(rule).groups >= 1:
                out.redirects.append(Redirect("pattern", rule, name))
            else:
                report.skip("failed", rule, limits.samples)
        for rule in p.get("rawRules", ()):
            if compiles(rule):
                out.raws.append(Raw(rule, name))
            else:
                report.skip("failed", rule, limits.samples)
    return out


def globs(values: Iterable[str]) -> tuple[Scope, ...]:
    return tuple(Scope("glob", v) for v in values)


def brave_clean(text: str, report: Report, limits: Limits) -> Source:
    out = Source()
    for entry in json.loads(text):
        for name in entry.get("params", ()):
            if not name:
                report.skip("unsupported", "empty name", limits.samples)
                continue
            out.params.append(Param("brave", Matcher("exact", name, "raw-name", True, True), include=globs(entry.get("include", ())), exclude=globs(entry.get("exclude", ()))))
    return out


def placeholders_ok(template: str, captures: int) -> bool:
    """Each of the groups, at most nine, is used once, and nothing else follows a '$'."""
    used = re.findall(r"\$(\d*)", template)
    return 1 <= captures <= 9 and sorted(used) == [str(i + 1) for i in range(captures)]


def brave_debounce(text: str, report: Report, limits: Limits) -> Source:
    out = Source()
    for e in json.loads(text):
        action, prepend, param = e.get("action"), e.get("prepend_scheme") or "", e.get("param") or ""
        scopes = {"include": globs(e.get("include", ())), "exclude": globs(e.get("exclude", ()))}
        if e.get("pref") or prepend not in ("", "http", "https") or action not in ("redirect", "base64,redirect", "regex-path", "regex-path-template"):
            report.skip("unsupported", str(action), limits.samples)
        elif action in ("redirect", "base64,redirect"):
            if not param:
                report.skip("failed", "no parameter", limits.samples)
                continue
            out.redirects.append(Redirect("query", names=(param,), decode="base64" if action != "redirect" else "", prepend=prepend, **scopes))
        elif not compiles(param) or not re.compile(param).groups:
            report.skip("failed", param, limits.samples)
        elif action == "regex-path-template" and not placeholders_ok(e.get("redirect_url_template") or "", re.compile(param).groups):
            report.skip("failed", "template", limits.samples)
        else:
            out.redirects.append(Redirect("path", param, template=e.get("redirect_url_template") if action == "regex-path-template" else None, prepend=prepend, **scopes))
    return out


def ad_guard(text: str, report: Report, limits: Limits, usage: str = "") -> Source:
    out = Source()
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "!#":
            continue
        inverted = line.startswith("@@")
        target, dollar, modifiers = line[2 * inverted :].partition("$")
        image = removes = case = bad = False
        value, domains = "", ()
        for m in modifiers.split(",") if dollar else ():
            key, _, v = m.partition("=")
            if key == "removeparam":
                removes, value = True, v
            elif key == "image":
                image = True
            elif key == "match-case":
                case = True
            elif key == "domain" and v and not re.search(r"[~*]", v):
                domains = tuple(d.lower() for d in v.split("|") if d)
            else:
                bad = True
        if bad or (image and removes) or (not removes and (inverted or (not image and usage != "mail-beacon"))) or (removes and not value and not inverted) or (dollar and not modifiers):
            report.skip("unsupported", line, limits.samples)
            continue
        scope = Scope("target", target, domains, case)
        if not removes:
            out.beacons.append(((scope,), ()))
            continue
        pattern = re.fullmatch(r"/(.*)/i?", value)
        if pattern and not compiles(pattern[1]):
            report.skip("failed", line, limits.samples)
            continue
        matcher = Matcher("regex", f"^(?:{pattern[1]})$", "decoded-pair", True, True) if pattern else Matcher("exact", value, "raw-name", case, True)
        out.params.append(Param("ad-guard", matcher, exception=inverted and bool(value), exception_all=inverted and not value, include=(scope,)))
    return out


PARSERS: dict[str, Callable[..., Source]] = {"clear-urls": clear_urls, "brave-clean-urls": brave_clean, "brave-debounce": brave_debounce, "ad-guard": ad_guard}


def source_name(name: str) -> str:
    """Without user information, query and fragment."""
    return re.sub(r"[?#].*$", "", re.sub(r"(?<=://)[^/@]*@", "", name))[:240]


@dataclass
class Ruleset:
    """All loaded rules, in load order, without duplicates."""

    providers: list[Provider]
    params: list[tuple[Param, frozenset[str]]]  # with the names of all providers that have it
    redirects: list[Redirect]
    beacons: list[tuple[tuple[Scope, ...], tuple[Scope, ...]]]
    raws: list[Raw]
    reports: list[Report]

    def stats(self) -> dict[str, int]:
        of = lambda k: sum(p.matcher.kind == k for p, _ in self.params)
        scopes = {s for p, _ in self.params for s in (*p.include, *p.exclude)} | {s for r in self.redirects for s in (*r.include, *r.exclude)}
        return {
            "sources": len(self.reports),
            "providers": len(self.providers),
            "params": len(self.params),
            "exact": of("exact"),
            "prefix": of("prefix"),
            "regex": of("regex"),
            "redirects": len(self.redirects),
            "beacons": len(self.beacons) + sum(p.complete for p in self.providers),
            "raw_rules": len(self.raws),
            "scopes": len(scopes),
            "duplicates": sum(r.duplicates for r in self.reports),
        }


def join(one: Ruleset, two: Ruleset) -> Ruleset:
    """Two built rulesets as one: the rules of the first come first, equal parameter rules are one rule of all their providers."""
    out = Ruleset(list(one.providers), list(one.params), list(one.redirects), list(one.beacons), list(one.raws), [*one.reports, *two.reports])
    at = {p_key(p): i for i, (p, _) in enumerate(out.params)}
    for p, names in two.params:
        if (i := at.get(p_key(p))) is None:
            at[p_key(p)] = len(out.params)
            out.params.append((p, names))
        else:
            out.params[i] = (out.params[i][0], out.params[i][1] | names)
    known = {p.name for p in out.providers}
    out.providers += [p for p in two.providers if p.name not in known]
    for mine, theirs in ((out.redirects, two.redirects), (out.beacons, two.beacons), (out.raws, two.raws)):
        mine += [x for x in theirs if x not in mine]
    return out


def without(rules: Ruleset, names: Iterable[str]) -> Ruleset:
    """A built ruleset without some providers; a parameter rule goes when it has no provider left."""
    off = {n.lower() for n in names}
    gone = lambda name: bool(name) and name.lower() in off
    params = []
    for p, of in rules.params:
        left = frozenset(n for n in of if n.lower() not in off)
        if left or not of:
            params.append((p if not gone(p.provider) else replace(p, provider=min(left)), left))
    return Ruleset([p for p in rules.providers if not gone(p.name)], params, [r for r in rules.redirects if not gone(r.provider)], list(rules.beacons), [r for r in rules.raws if not gone(r.provider)], list(rules.reports))


def p_key(p: Param, own: bool = False) -> tuple:
    """What makes two parameter rules equal."""
    return (p.source == "clear-urls" and p.is_global, p.referral, p.exception, p.exception_all, p.matcher, frozenset(p.include), frozenset(p.exclude), own and p.is_global)


def load(packs: Iterable[tuple[str, str | bytes]] = (), *, formats: dict[str, str] | None = None, usage: dict[str, str] | None = None, disabled: Iterable[str] = (), limits: Limits = Limits(), with_builtin: bool = True) -> Ruleset:
    """Compile packs (name, text), the built-in one first; of packs of one name the first counts.

    A pack that can't be parsed or exceeds a budget contributes nothing; its report says why.
    """
    off = {d.lower() for d in disabled}
    sources: list[tuple[str, str]] = [("builtin", json.dumps(builtin.pack()))] if with_builtin else []
    for name, text in packs:
        if name not in {n for n, _ in sources}:
            sources.append((name, text.decode("utf-8", "replace") if isinstance(text, bytes) else text))
    out = Ruleset([], [], [], [], [], [])
    seen: dict = {}
    total = external = 0
    for name, text in sources:
        own = name == "builtin" and with_builtin
        report = Report(source_name(name), (formats or {}).get(name) or detect(text) or "")
        out.reports.append(report)
        size = len(text.encode())
        external += not own
        if not own and external > limits.sources:
            report.error = "too many sources"
        elif not own and size > limits.source_bytes:
            report.error = "source too large"
        elif not own and total + size > limits.total_bytes:
            report.error = "all sources too large"
        elif report.format not in PARSERS:
            report.error = "unknown format"
        if report.error:
            continue
        try:
            extra = {"usage": (usage or {}).get(name, "")} if report.format == "ad-guard" else {}
            ir = PARSERS[report.format](text, report, limits, **extra)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            report.error = f"bad source: {e}"[:200]
            continue
        if not own and (ir.rules() > limits.rules or ir.regexes() > limits.regexes):
            report.error = "too many rules"
            continue
        total += size * (not own)
        out.providers += [p for p in ir.providers if p.name.lower() not in off]
        for p in ir.params:
            if p.provider and p.provider.lower() in off:
                continue
            key = p_key(p, own)
            if key in seen:
                at = seen[key]
                out.params[at] = (out.params[at][0], out.params[at][1] | ({p.provider} if p.provider else set()))
                report.duplicates += 1
            else:
                seen[key] = len(out.params)
                out.params.append((p, frozenset([p.provider] if p.provider else ())))
                report.loaded += 1
        for name_of, into, items in (("provider", out.redirects, ir.redirects), ("", out.beacons, ir.beacons), ("provider", out.raws, ir.raws)):
            fresh = [x for x in items if not (name_of and x.provider and x.provider.lower() in off)]
            into += fresh
            report.loaded += len(fresh)
    return out
