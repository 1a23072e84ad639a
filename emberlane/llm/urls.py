"""URL filters: pattern rules found by their rarest literal token.

Method. A rule is a regular expression over ``host + path`` with the literals that any match must hold.
Each rule is filed under that literal token of its own that is rarest among all rules. A url's tokens
fetch the candidates, and only those run their expression. Of the fitting rules the longest decides;
without one, the general patterns (filed in the same way) decide, and else the url is allowed.

Edge cases. A null url or one without ``://`` has an empty host and path and fits no rule. Repeated rows
each get a row; null page ids stay null. Very long urls are judged whole; of patterns that fit, an exception
and then the longest counts, and then the name. An empty table gives no rows. Other columns are not read. The
rules are a driver-side list, so what is sent to the workers is that list alone.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched at the start of host + path; ``literals`` are tokens that each match has."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int = field(default=0)


def host_rule(name: str, verdict: str) -> Rule:
    """A rule ``host/path`` that fits the host, its subdomains and every path that starts so.

    The rule's first and last tokens may be continued in the url (``/de`` fits ``/den``), so only tokens
    that end before the rule does are literals, besides those of the host.
    """
    host, slash, path = name.partition("/")
    whole = [m.group() for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host + slash + path)}", tuple(TOKEN.findall(host) + [x for x in whole if x]), len(name))


_EDGE = r"(?:[^a-z0-9_.%\-]|$)"


def pattern_rule(line: str) -> Rule:
    """A rule of a filter list: ``||host`` starts at a label of the host, ``|`` is an end, ``*`` anything, ``^`` a separator.

    ``@@`` in front makes it an exception. Anything else is literal and may lie anywhere in host + path, in lower case. A token
    is a literal to file the rule under if it cannot be part of a longer one: something other than ``*`` is on both sides.
    """
    body = line.removeprefix("@@")
    label, start = body.startswith("||"), body.startswith("|")
    stop = body.endswith("|") and len(body) > 2
    body = body.lstrip("|")[: -1 if stop else None]
    pattern = "".join(".*" if c == "*" else _EDGE if c == "^" else re.escape(c) for c in body)
    head = r"(?:[^/]*[.])?" if label else "" if start else ".*"
    whole = []
    for m in TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else start
        right = body[m.end()] != "*" if m.end() < len(body) else stop
        if left and right:
            whole.append(m.group())
    return Rule(line, "allow" if line.startswith("@@") else "block", f"(?s:{head}{pattern}{'$' if stop else ''})", tuple(whole), len(line) + 1000 * line.startswith("@@"))


def word_rule(word: str) -> Rule:
    """``word`` (tokens joined by hyphens) between dots or hyphens of the host."""
    return Rule(word, "block", rf"(?:[^/]*[.\-])?{re.escape(word)}(?:[.\-/:]|$)", tuple(TOKEN.findall(word)), 0)


#: The rules of the query, longest first where they overlap.
RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: What decides where no rule fits. Words of hosts: gambling, pharmacies, adult sites, trackers, link farms.
HOST_WORDS = (
    "casino", "casinos", "poker", "bet", "bets", "betting", "sportsbook", "slots", "jackpot", "roulette", "lottery",
    "pills", "viagra", "cialis", "pharmacy", "steroids",
    "porn", "xxx", "sex", "adult", "escort", "escorts", "camgirls", "nude",
    "ads", "adserver", "adservice", "adclick", "popads", "popunder", "tracker", "tracking", "clicktrack", "telemetry", "affiliates",
    "spam", "linkfarm", "link-farm", "seo-links", "backlinks", "doorway", "parked", "domain-parking", "free-download", "warez", "keygen", "torrents", "replica-watches", "payday-loans",
)
#: And patterns of hosts and paths.
PATTERN_LINES = (
    "||doubleclick.^", "||googlesyndication.^", "||adnxs.^", "||taboola.^", "||outbrain.^", "||*.click/|", "||*.loan^", "||*.gq^",
    "/adserver/", "/adclick/", "/ads/banner^", "/banners/ad^", "/popunder/", "/track/pixel^", "/pixel.gif|", "/affiliate/*/click^", "/out/*/redirect^", "/go/casino^", "/wp-login.php^", "/xmlrpc.php^",
    "/cgi-bin/*/redirect^", "/tag/page/*/feed^", "/search/label/*/max-results^", "/porn/", "/xxx/", "/viagra^", "/online-casino^", "/buy-cheap-", "/payday-loan^", "@@/ads/policy^", "@@||ads.gov^",
)
PATTERNS = tuple(word_rule(w) for w in HOST_WORDS) + tuple(pattern_rule(x) for x in PATTERN_LINES)


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: tuple[Rule, ...]):
        seen = Counter(t for r in rules for t in set(r.literals))
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.rest = [(r, re.compile(r.pattern)) for r in rules if not r.literals]
        for r in rules:
            if r.literals:
                self.by_token[min(r.literals, key=lambda t: (seen[t], -len(t), t))].append((r, re.compile(r.pattern)))

    def best(self, target: str, tokens: set[str]) -> Rule | None:
        found, by_token = None, self.by_token
        for t in tokens:
            for r, p in by_token.get(t, ()):
                if (found is None or (r.rank, r.name) > (found.rank, found.name)) and p.match(target):
                    found = r
        for r, p in self.rest:
            if (found is None or (r.rank, r.name) > (found.rank, found.name)) and p.match(target):
                found = r
        return found


def filter_urls(pages: DataFrame, *, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` of every url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    parts = (
        pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
        .select("page_id", F.coalesce(F.regexp_extract(rest, r"\A([^?#]*)", 1), F.lit("")).alias("_r"))
        .select("page_id", F.translate(F.regexp_extract("_r", r"\A([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract("_r", r"(?s)\A[^/]*(.*)", 1).alias("path"))
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, general = RuleIndex(rules), RuleIndex(patterns)
        for batch in batches:
            names, verdicts, why = [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                target = host + path
                tokens = set(TOKEN.findall(target))
                rule = index.best(target, tokens)
                low = target.lower()
                pattern = None if rule else general.best(low, tokens if low == target else set(TOKEN.findall(low)))
                names.append(rule and rule.name)
                why.append(pattern and pattern.name)
                verdicts.append((rule or pattern).verdict if rule or pattern else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(why, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, pattern string")
