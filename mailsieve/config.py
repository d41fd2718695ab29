"""Configuration and sender policies."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace

from .functions.url import host_in
from .rules.packs import Limits, Ruleset, load

# Senders whose links are left alone.
SENSITIVE = """
accounts.google.com google.com login.microsoftonline.com microsoft.com apple.com okta.com auth0.com duosecurity.com
paypal.com paypal.nl paypal.be paypal.de paypal.fr paypal.it paypal.es paypal.co.uk stripe.com wise.com revolut.com
americanexpress.com chase.com bankofamerica.com kraken.com degiro.com degiro.nl rabobank.nl overheid.nl digid.nl
github.com gitlab.com
""".split()


@dataclass(frozen=True)
class Policy:
    match_domains: tuple[str, ...]
    mode: str | None = None
    no_modify: bool | None = None
    clean_html: bool | None = None
    remove_pixels: bool | None = None
    clean_query_params: bool | None = None
    unwrap_known_redirects: bool | None = None


@dataclass(frozen=True)
class Config:
    mode: str = "enforce"
    clean_html: bool = True
    clean_text_plain: bool = False
    remove_pixels: bool = True
    neutralize_css_beacons: bool = True
    strip_link_ping: bool = True
    clean_query_params: bool = True
    apply_vendor_rules: bool = True
    strip_referral_marketing: bool = False
    unwrap_known_redirects: bool = True
    network_redirect_resolution: bool = False
    preserve_original_href: bool = False
    debug_preserve_removed: bool = False
    protect_sensitive_senders: bool = True
    surface_unsubscribe: bool = True
    fail_open: bool = True
    max_message_size: int = 52_428_800
    max_html_part_size: int = 8_388_608
    timeout_ms: int = 1500
    listen: str = "127.0.0.1:11333"
    sender_policies: tuple[Policy, ...] = ()
    allowlisted_redirect_domains: tuple[str, ...] = ()
    blocked_domains: tuple[str, ...] = ()
    extra_pixel_domains: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    extra_tracking_params: tuple[str, ...] = ()
    keep_params: tuple[str, ...] = ()
    disabled_providers: tuple[str, ...] = ()
    rule_packs: tuple[str, ...] = ()
    rule_pack_urls: tuple[str, ...] = ()
    rule_pack_sources: tuple[dict, ...] = field(default=())
    rule_limits: Limits = Limits()

    def for_sender(self, domain: str | None) -> tuple[Config, str]:
        """The configuration for a sender and the name of the policy; the first policy that matches counts."""
        out, label = self, "default"
        if domain and self.protect_sensitive_senders and host_in(domain, SENSITIVE):
            out = replace(out, clean_query_params=False, unwrap_known_redirects=False, apply_vendor_rules=False, clean_text_plain=False)
            label = "sensitive-sender"
        for p in self.sender_policies if domain else ():
            if host_in(domain, p.match_domains):
                names = ("clean_html", "remove_pixels", "clean_query_params", "unwrap_known_redirects")
                out = replace(out, **{k: getattr(p, k) for k in names if getattr(p, k) is not None})
                mode = p.mode or ("report-only" if p.no_modify else None)
                return (replace(out, mode=mode) if mode else out), f"custom:{next(d for d in p.match_domains if host_in(domain, [d]))}"
        return out, label


def parse_toml(text: str) -> Config:
    """A configuration from TOML; unknown keys are errors."""
    raw = tomllib.loads(text)
    known = {f.name for f in fields(Config)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    if "sender_policies" in raw:
        raw["sender_policies"] = tuple(Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()}) for p in raw["sender_policies"])
    if "rule_limits" in raw:
        raw["rule_limits"] = Limits(**raw["rule_limits"])
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


#: In place of a pack without transport security, which is not read: no format, so its report has an error.
INSECURE = b"["
#: What rules were compiled from, and the rules; a few are kept.
CACHE: dict[tuple, Ruleset] = {}
CACHED = 16


def finalize(config: Config, loader: Callable[[str], bytes] | None = None) -> Ruleset:
    """Compile the rules that a configuration names, each source string once, first come first.

    Sources are read again each time; if these and all settings that rules depend on are as before, the compiled rules
    are given again.  Resolving over the network is an operator of its own (see ``functions.network``) and needs
    requests of the caller's.
    """
    formats, usage, order = {}, {}, []
    every: Iterable[tuple[str, str, str]] = [*((p, "", "") for p in config.rule_packs), *((u, "clear-urls", "") for u in config.rule_pack_urls), *((s["source"], s.get("format", ""), s.get("usage", "")) for s in config.rule_pack_sources)]
    for name, fmt, use in every:
        if name not in order:
            order.append(name)
            formats[name], usage[name] = fmt, use

    def fetch(name: str) -> bytes:
        if loader:
            return loader(name)
        if "://" in name and not name.startswith("file://"):
            raise OSError("remote packs need a loader")
        with open(name.removeprefix("file://"), "rb") as f:
            return f.read(config.rule_limits.source_bytes + 1)

    packs = []
    for name in order:
        if name.startswith("http://"):
            packs.append((name, INSECURE))
            continue
        try:
            packs.append((name, fetch(name)))
        except OSError:
            packs.append((name, b""))
    key = (tuple(packs), tuple(formats.items()), tuple(usage.items()), config.disabled_providers, config.rule_limits)
    if key not in CACHE:
        while len(CACHE) >= CACHED:
            CACHE.pop(next(iter(CACHE)))
        CACHE[key] = load(packs, formats={k: v for k, v in formats.items() if v}, usage=usage, disabled=config.disabled_providers, limits=config.rule_limits)
    return CACHE[key]
