"""URL verdicts: host and path rules first, then a weighted vocabulary matched by Aho-Corasick.

A rule names a host and the beginning of a path, and fits the host itself and all of its subdomains;
of several fitting rules the longest (host and path together) wins.  URLs without a rule are judged
by words: one automaton over strict and soft terms runs over the lower-cased URL, hits must have no
ASCII letter or digit beside them, and a URL is blocked by one strict term or by distinct soft terms
whose weights reach ``limit``.

Defined results: null URLs and those without :// have an empty host and path and no rule (they are
still judged by words, null as the empty text); hits of one soft term count once; repeated rows get
equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.columns import fresh, map_in_arrow, named
from quarry.plans.scratch import ship

#: (host, path, verdict): the contract's rules.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Terms that block alone.
STRICT = ("porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirl", "camgirls", "milf", "bdsm", "casino", "viagra", "cialis", "warez")
#: Terms with weights; a URL is blocked when those of distinct terms reach LIMIT, so never by one.
SOFT = {
    "adult": 2, "bet": 1, "betting": 2, "cams": 2, "cheap": 1, "crack": 1, "dating": 1, "erotic": 2, "erotik": 2, "fetish": 2, "free": 1,
    "gambling": 2, "gratis": 1, "gratuit": 1, "hot": 1, "jackpot": 2, "keygen": 2, "live": 1, "loan": 1, "nackt": 2, "naked": 1, "nude": 2,
    "payday": 2, "pharmacy": 1, "pills": 2, "poker": 2, "serial": 1, "sex": 2, "sexe": 2, "sexo": 2, "sexy": 2, "slots": 1, "torrent": 1, "webcam": 1,
}
LIMIT = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://, or empty.  Found by position: a pattern would go on to a later one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _blocks(automaton, text: str, limit: int) -> bool:
    soft: dict[str, int] = {}
    for end, (term, weight) in automaton.iter(text):
        start = end - len(term) + 1
        if start and text[start - 1].isascii() and text[start - 1].isalnum():
            continue
        if end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalnum():
            continue
        if weight is None:
            return True
        soft[term] = weight
    return sum(soft.values()) >= limit


def judge_urls(pages: DataFrame, url_col: str = "url", keep: list[str] | None = None, rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """pages' columns in ``keep`` (all, if None) with host, path, rule and verdict."""
    ship(pages.sparkSession)
    added = ["host", "path", "rule", "verdict"]
    names = [c for c in (pages.columns if keep is None else keep) if c not in added]
    source = fresh("_url", [*names, *added])
    schema = T.StructType([*[pages.schema[c] for c in names], *[T.StructField(c, T.StringType()) for c in (source, *added)]])
    terms = [(t, (t, None)) for t in strict] + [(t, (t, w)) for t, w in soft.items()]
    lower = str.maketrans(_UPPER, _LOWER)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, value in terms:
            automaton.add_word(t, value)
        automaton.make_automaton()
        for batch in batches:
            verdicts = [
                v or ("block" if _blocks(automaton, (u or "").translate(lower), limit) else "allow")
                for u, v in zip(batch.column(source).to_pylist(), batch.column("verdict").to_pylist())
            ]
            yield batch.set_column(batch.schema.get_field_index("verdict"), "verdict", pa.array(verdicts, pa.string()))

    url = named(pages, url_col)
    parts = pages.select(*[named(pages, c) for c in names], url.alias(source), host_of(url).alias("host"), path_of(url).alias("path"))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    return map_in_arrow(parts.withColumns({"rule": fit["rule"], "verdict": fit["verdict"]}), run, schema).drop(source)


def oracle_sql(rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> str:
    """The same verdicts in DuckDB SQL."""
    fits = [
        (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    ]
    pick = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    weight = reduce(lambda a, b: f"{a} + {b}", [f"CASE WHEN {hit(t)} THEN {w} ELSE 0 END" for t, w in soft.items()])
    cut = lambda x: f"split_part(split_part({x}, '?', 1), '#', 1)"
    return f"""
    WITH rest AS (
      SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
    ), cuts AS (
      SELECT page_id, low, {cut("tail")} AS upto, split_part({cut("tail")}, '/', 1) AS name FROM rest
    ), parts AS (
      SELECT page_id, low, translate(name, '{_UPPER}', '{_LOWER}') AS host, substr(upto, length(name) + 1) AS path FROM cuts
    )
    SELECT page_id, host, path, {pick(1)} AS rule,
           coalesce({pick(2)}, CASE WHEN {hit("(" + "|".join(strict) + ")")} OR {weight} >= {limit} THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts"""
