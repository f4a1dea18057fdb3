"""URL filters: host and path rules, and a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowset.llm.common import fresh

#: A small vocabulary to begin with; read_terms() takes a larger one from a table. One hit of a strict term rejects; so do SOFT_HITS different soft terms. A hit has no letter or digit beside it.
STRICT = ("adult-x", "casino", "escort", "hentai", "porn", "viagra", "xxx")
SOFT = ("ads", "adult", "bet", "bets", "cheap", "farm", "free", "loan", "pills", "poker", "sex", "slots", "spam", "track", "win")
SOFT_HITS = 2


@dataclass(frozen=True)
class Rule:
    """Fits the host and all its subdomains, where the path starts with `path`. verdict: allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null without one; of equally long ones that with the longer host.
    Rules are a short fixed list, tried from long to short in one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def count_terms(url: str, automaton) -> tuple[int, set[str]]:
    """(number of strict hits, the different soft terms) in the whole url, A-Z lower-cased, hits between boundaries."""
    low = url.translate(LOWER)
    strict, soft = 0, set()
    for end, (term, is_strict) in automaton.iter(low):
        start = end - len(term) + 1
        if (start and _word(low[start - 1])) or (end + 1 < len(low) and _word(low[end + 1])):
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, soft


LOWER = {c: c + 32 for c in range(65, 91)}


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def read_terms(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) of a vocabulary in Parquet with the columns term and strict (boolean). Null and empty terms are
    left out. The vocabulary is held in memory by the driver and each worker: some 10^5 terms, not what grows with the
    urls."""
    rows = spark.read.parquet(path).filter("term <> '' and strict is not null").select("term", "strict").distinct().collect()
    return tuple(sorted(r["term"] for r in rows if r["strict"])), tuple(sorted(r["term"] for r in rows if not r["strict"]))


@lru_cache(maxsize=2)
def build(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT):
    """The automaton of all terms, A-Z lower-cased like the urls, once for each Python worker; None without terms. What is
    strict and soft is strict."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for terms, is_strict in ((soft, False), (strict, True)):
        for term in (t.translate(LOWER) for t in terms if t):
            automaton.add_word(term, (term, is_strict))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def judge_urls(df: DataFrame, rules: tuple[Rule, ...] = (), url_col: str = "url", strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS) -> tuple[DataFrame, dict[str, str]]:
    """df with host, path, rule, strict_hits, soft_hits and verdict (allow or block), and the names they got.

    The rule's verdict holds; without one a strict hit or soft_hits different soft hits block. Null and empty urls have
    no hits and no host and are allowed. Long urls are read whole. Repeated rows are judged alike, an empty table stays
    empty, and columns of any name are allowed. Each row is judged by itself: no shuffle.
    """
    names: dict[str, str] = {}
    for c in ("host", "path", "rule", "strict_hits", "soft_hits", "verdict", "url_hits"):
        names[c] = fresh(c, [*df.columns, *names.values()])
    found = names.pop("url_hits")

    @F.pandas_udf("strict int, soft int")
    def hits(urls):
        import pandas as pd

        automaton = build(strict, soft)
        found = [count_terms(u, automaton) if u and automaton else (0, ()) for u in urls]
        return pd.DataFrame({"strict": [a for a, _ in found], "soft": [len(b) for _, b in found]}, dtype="int32")

    url = F.col(f"`{url_col}`")
    out = df.withColumns({names["host"]: host_of(url), names["path"]: path_of(url), found: hits(url)})
    name, verdict = rule_of(F.col(names["host"]), F.col(names["path"]), rules)
    out = out.withColumns({names["rule"]: name, names["strict_hits"]: F.col(f"{found}.strict"), names["soft_hits"]: F.col(f"{found}.soft")})
    bad = (F.col(names["strict_hits"]) > 0) | (F.col(names["soft_hits"]) >= soft_hits)
    return out.withColumn(names["verdict"], F.coalesce(verdict, F.when(bad, F.lit("block")).otherwise(F.lit("allow")))).drop(found), names
