"""URL filters: a weighted vocabulary and host and path rules.

One Aho-Corasick pass over a URL finds the terms of the vocabulary; a hit counts
only between characters that are no letters or digits. A strict term rejects by
itself. Soft terms have weights; the distinct ones found reject together, if they
are several and their weights reach a threshold. A rule for the host and path, if
one fits, decides instead; the longest wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm.common import per_batch

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

STRICT = ("casino", "porn", "porno", "xxx", "viagra", "cialis", "hentai", "camgirls", "adult-x", "torrent-free", "phishing", "malware")
SOFT = {
    "adult": 1.5, "sex": 1.5, "escort": 1.5, "nude": 1.5, "bets": 1.0, "betting": 1.0, "bet": 0.5, "poker": 1.0, "slots": 1.0, "jackpot": 1.0,
    "pills": 1.0, "pharmacy": 0.5, "cheap": 0.5, "discount": 0.5, "free": 0.5, "win": 0.5, "bonus": 0.5, "prize": 0.5, "spam": 1.5, "farm": 0.5,
    "ads": 1.0, "adserver": 1.0, "track": 0.5, "tracker": 0.5, "tracking": 0.5, "popup": 1.0, "click": 0.5, "redirect": 0.5, "crack": 1.0, "warez": 1.5,
}

#: (verdict, host, path): fits the host and its subdomains, if the path starts so.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


@dataclass(frozen=True)
class Policy:
    strict: tuple[str, ...] = STRICT
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT))
    several: int = 2
    weight: float = 1.5
    rules: tuple[tuple[str, str, str], ...] = RULES


def split(url: str | None) -> tuple[str, str]:
    """(host, path): the host with A-Z lower-cased, after the first "://" up to
    "/", "?", "#" or the end; the path from there up to "?", "#" or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(ASCII_LOWER), slash + path


def rule_for(host: str, path: str, rules) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equals, a blocking one."""
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


class Judge:
    def __init__(self, policy: Policy):
        self.policy = policy
        self.automaton = ahocorasick.Automaton()
        for term in (*policy.soft, *policy.strict):  # a term in both is strict
            self.automaton.add_word(term, term)
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()
        self.strict = set(policy.strict)

    def terms(self, url: str) -> tuple[int, list[str]]:
        """(number of strict hits, the distinct soft terms in order)."""
        text = url.translate(ASCII_LOWER)
        strict, soft = 0, set()
        for last, term in self.automaton.iter(text) if self.ready and text else ():
            first = last - len(term) + 1
            if (first and text[first - 1].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
                continue
            if term in self.strict:
                strict += 1
            else:
                soft.add(term)
        return strict, sorted(soft)

    def __call__(self, url: str | None) -> tuple:
        """(host, path, rule, verdict, strict hits, distinct soft hits, their weight)."""
        host, path = split(url)
        strict, soft = self.terms(url or "")
        weight = sum(self.policy.soft[t] for t in soft)
        bad = strict > 0 or (len(soft) >= self.policy.several and weight >= self.policy.weight)
        rule, verdict = rule_for(host, path, self.policy.rules) or (None, "block" if bad else "allow")
        return host, path, rule, verdict, strict, len(soft), float(weight)


def judge(pages: DataFrame, policy: Policy = Policy(), id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, weight) of each
    row. A null URL, or one without "://", has an empty host and path; a null one
    is allowed. Repeated rows are judged each; null ids stay null; further columns
    play no part."""

    def work():
        of = Judge(policy)

        def each(batch: pa.RecordBatch) -> dict:
            got = [of(u) for u in batch.column(1).to_pylist()]
            names = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")
            return {"page_id": batch.column(0)} | dict(zip(names, map(list, zip(*got, strict=True)), strict=True))

        return each

    return per_batch(pages.selectExpr(f"cast(`{id}` as long) page_id", f"cast(`{url}` as string) url"), work, "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight double")


def sql(policy: Policy = Policy()) -> str:
    """DuckDB SQL for judge() over the table pages, for terms of ASCII letters,
    digits and hyphens and URLs whose letters and digits are ASCII."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    bounded = lambda t: quote(rf"(^|[^\pL\pN]){t}([^\pL\pN]|$)")
    # strict hits are counted with overlapping bounds: take each bound as seen, not eaten
    strict = " + ".join(f"len(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, {len(t)}) = {quote(t)} and not regexp_matches(substr(low, greatest(i - 1, 1), (i > 1)::int), '[\\pL\\pN]') and not regexp_matches(substr(low, i + {len(t)}, 1), '[\\pL\\pN]')))" for t in policy.strict) or "0"
    soft = [f"(regexp_matches(low, {bounded(t)}))::int" for t in policy.soft if t not in policy.strict]
    weights = [f"{w!r} * (regexp_matches(low, {bounded(t)}))::int" for t, w in policy.soft.items() if t not in policy.strict]
    fits = lambda h, p: f"((host = {quote(h)} or suffix(host, {quote('.' + h)})) and prefix(path, {quote(p)}))"
    by_length = sorted(policy.rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    when = lambda value, other: "case " + " ".join(f"when {fits(h, p)} then {quote(value(v, h, p))}" for v, h, p in by_length) + f" else {other} end" if by_length else other
    return f"""
with a as (select page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low,
    case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a),
c as (select *, ({strict})::int strict_hits, ({' + '.join(soft) or '0'})::int soft_hits, ({' + '.join(weights) or '0'})::double weight from b)
select page_id, host, path, {when(lambda v, h, p: h + p, 'null')} rule,
    {when(lambda v, h, p: v, f"case when strict_hits > 0 or (soft_hits >= {policy.several} and weight >= {policy.weight}) then 'block' else 'allow' end")} verdict,
    strict_hits, soft_hits, weight from c"""
