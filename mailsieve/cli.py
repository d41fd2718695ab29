"""Commands on single messages, pages and URLs, and on folders of messages: python -m mailsieve.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from .config import Config, finalize, parse_toml
from .functions.engine import Engine
from .functions.html import clean_html
from .functions.mime import clean_message_fail_open, header_block, sender_domain, unsubscribe_targets
from .functions.url import parse
from .plans.reports import line_diff, message_links, rule_stats_json

COUNTERS = ("html_parts", "urls_cleaned", "redirects_unwrapped", "pixels_removed", "pings_stripped")


def engine_of(args) -> Engine:
    config = parse_toml(Path(args.config).read_text()) if getattr(args, "config", None) else Config()
    config = replace(config, rule_packs=(*config.rule_packs, *args.rule_pack))
    return Engine(finalize(config), config)


def explain_url(text: str, engine: Engine) -> list[str]:
    url = parse(text)
    if url is None:
        raise ValueError(f"no URL: {text}")
    got, cleaned = engine.unwrap(url), engine.clean(url)
    out = [f"input: {url}", f"provider: {engine.provider(str(url)) or '(none)'}", f"unwrapped: {f'yes, {got.url}' if got.unwrapped else 'no'}"]
    out += [f"rejected: {got.rejected}"] if got.rejected else []
    return [*out, f"removed: {', '.join(cleaned.removed) or '(nothing)'}", f"final: {got.url}"]


def explain_message(raw: bytes, engine: Engine) -> list[str]:
    headers, _ = header_block(raw, 0, len(raw))
    sender = sender_domain(headers)
    config, policy = engine.config.for_sender(sender)
    done = clean_message_fail_open(raw, engine)
    out = [f"sender: {sender or '(unknown)'}", f"policy: {policy}", f"mode: {config.mode}", f"unsubscribe: {', '.join(unsubscribe_targets(headers)) or '(none)'}"]
    out += [f"[{x['place']}] {x['href']}: {x['verdict']}" + (f" -> {x['new_href']}" if x["new_href"] else "") for x in message_links(raw, engine)]
    return [*out, *(f"{k}: {getattr(done, k)}" for k in COUNTERS), *(f"{k}: {v}" for k, v in done.headers)]


def print_trackers(raw: bytes, engine: Engine) -> list[str]:
    out, wrappers, params = [], 0, 0
    for x in message_links(raw, engine):
        if x["verdict"] == "sensitive":
            continue
        if x["provider"]:
            wrappers += 1
            out.append(f"[redirect:{x['provider']}] {x['href']}" + (f" -> {x['new_href']}" if x["verdict"] == "unwrap" else f" {x['verdict']}"))
        if x["removed"]:
            params += 1
            out.append(f"[params] {x['href']}: {', '.join(x['removed'])}")
    done = clean_message_fail_open(raw, engine)
    return [*out, f"summary: redirect_wrappers={wrappers} param_tracking_links={params} tracking_pixels={done.pixels_removed} link_pings={done.pings_stripped}"]


def test_rules(folder: str, engine: Engine) -> tuple[list[str], int]:
    """A line for each message file, by name; the number that failed."""
    files = sorted(Path(folder).glob("*.eml"))
    if not files:
        raise ValueError(f"no *.eml files in {folder}")
    out, bad = [], 0
    for f in files:
        try:
            done = clean_message_fail_open(f.read_bytes(), engine)
            state = "FAIL-OPEN" if done.error else "ok"
        except Exception as e:  # fail_open is off
            done, state = None, f"ERROR {e}"
        bad += state != "ok"
        out.append(f"[{state}] {f.name}" + (": " + " ".join(f"{k}={getattr(done, k)}" for k in (*COUNTERS, "modified")) if done else ""))
    return [*out, f"{len(files)} messages, {bad} failures"], bad


def main(argv: list[str] | None = None, stdin=None, stdout=None) -> int:
    stdin, stdout = stdin or sys.stdin.buffer, stdout or sys.stdout.buffer
    top = argparse.ArgumentParser(prog="mailsieve")
    top.add_argument("--rule-pack", action="append", default=[])
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("clean-message", "clean-html", "explain-url", "explain-message", "print-trackers", "diff-message", "test-rules", "rule-stats"):
        c = commands.add_parser(name)
        c.add_argument("--config")
        c.add_argument("--rule-pack", action="append", default=argparse.SUPPRESS)
        if name == "clean-html":
            c.add_argument("--base-url")
        if name == "rule-stats":
            c.add_argument("--json", action="store_true")
        if name in ("explain-url", "test-rules"):
            c.add_argument("what")
    args = top.parse_args(argv)
    say = lambda lines: stdout.write("".join(f"{x}\n" for x in lines).encode())
    try:
        engine = engine_of(args)
        if args.command == "clean-message":
            stdout.write(clean_message_fail_open(stdin.read(), engine).cleaned)
        elif args.command == "clean-html":
            stdout.write(clean_html(stdin.read().decode("utf-8", "replace"), engine, base_url=args.base_url).html.encode())
        elif args.command == "explain-url":
            say(explain_url(args.what, engine))
        elif args.command == "explain-message":
            say(explain_message(stdin.read(), engine))
        elif args.command == "print-trackers":
            say(print_trackers(stdin.read(), engine))
        elif args.command == "diff-message":
            raw = stdin.read()
            say(line_diff(raw.decode("utf-8", "replace"), clean_message_fail_open(raw, engine).cleaned.decode("utf-8", "replace")) or ["(no differences)"])
        elif args.command == "test-rules":
            lines, bad = test_rules(args.what, engine)
            say(lines)
            return int(bad > 0)
        elif args.json:
            say([rule_stats_json(engine.rules)])
        else:
            say([f"{k}: {v}" for k, v in engine.rules.stats().items()])
            say([f"{r.source}: format={r.format} loaded={r.loaded} duplicates={r.duplicates} unsupported={r.unsupported} failed={r.failed}" + (f" error={r.error}" if r.error else "") for r in engine.rules.reports])
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
