"""URL verdicts: rules by host and path first, link-graph propagation between hosts for the rest.

Pages that rules allow or block make their hosts seeds, each with the share of its pages. Trust flows along links
(personalised PageRank from trusted hosts), distrust against them (from blocked hosts to those that link there). A host with
more distrust than trust is blocked. Everything is native: links are cut out of the HTML by one regular expression, edges are
counted before any shuffle carries them, and a round is one join and one aggregate over host edges. Ranks are whole numbers
(a full seed is SEED), so sums don't depend on their order. A round passes on what the one before it added to each rank, and the
last one is that in which no rank grows by a whole unit; as each hands on at most 85 in a hundred, there are some 255 rounds and
6 more for each factor of 2.6 between all seeds and a full one, or as many as the longest way if no links lead back.

Nulls: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed; null html has no links.
Repeated rows are judged alike. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.session import cut_lineage

SEED = 10**18
DAMPING = 0.85
RANK = "decimal(38,0)"
#: A full seed and the number of rounds in the SQL check, which is coarser than the query.
SCALE, ROUNDS = 1_000_000_000, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of links with an absolute target; others stay on their own host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct of text and verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a later one goes before those so far
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts with their number."""
    return (
        pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
        .select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    )


def _share(rank: Column, part: Column, total: Column) -> Column:
    """The whole number of units in ``rank * part / total``, without a product that could pass 38 digits."""
    rank, part, total = rank.cast(RANK), part.cast("decimal(19,0)"), total.cast("decimal(19,0)")
    rest = rank % total
    whole = ((rank - rest).cast(RANK) / total).cast(RANK)
    odd = (rest * part).cast(RANK)
    return (whole * part + (odd - odd % total).cast(RANK) / total).cast(RANK)


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) once no rank grows by a unit any more. ``seeds`` has host, trust and distrust from 0 to SEED."""
    hundredths = lambda x: _share(F.col("rank"), F.lit(x), F.lit(100))
    damping = round(100 * DAMPING)
    into = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    both = cut_lineage(
        edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w", "total")
        .unionByName(edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "w", "total"))
    )
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust").cast(RANK), F.lit("distrust"), F.col("distrust").cast(RANK))).alias("kind", "rank")).where("rank > 0")
    # what a rank is so far, and what the last round added to it
    state = cut_lineage(start.select("kind", "host", hundredths(100 - damping).alias("rank")).withColumn("new", F.col("rank")))
    more = not both.isEmpty()
    while more:
        passed = state.where("new > 0").select("kind", "host", F.col("new").alias("rank")).withColumn("rank", hundredths(damping)).join(both, ["kind", "host"])
        passed = passed.select("kind", F.col("to").alias("host"), F.lit(0).cast(RANK).alias("rank"), _share(F.col("rank"), F.col("w"), F.col("total")).alias("new")).where("new > 0")
        summed = state.select("kind", "host", "rank", F.lit(0).cast(RANK).alias("new")).unionByName(passed).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("new").alias("new"))
        state = cut_lineage(summed.select("kind", "host", (F.col("rank") + F.col("new")).cast(RANK).alias("rank"), F.col("new").cast(RANK).alias("new")))
        more = not state.where("new > 0").isEmpty()
    return state.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0)).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    parsed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("_fit", longest_rule(rules, F.col("host"), F.col("path")))
    judged = parsed.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("_verdict"))
    share = lambda v: _share(F.lit(SEED), F.count(F.when(F.col("_verdict") == v, 1)), F.count("*"))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagate(seeds, cut_lineage(host_edges(parsed)))
    blocked = ranks.where("distrust > trust").select("host", F.lit("block").alias("_host"))
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("_verdict", "_host", F.lit("allow")).alias("verdict"))


def judge_sql(rules: list[Rule], rounds: int = ROUNDS) -> str:
    """The same verdicts in DuckDB's SQL."""
    fits = " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{{}}{r.text}'" for r in sorted(rules, key=lambda r: (-len(r.text), r.text)))
    verdict = " ".join(f"when rule = '{r.text}' then '{r.verdict}'" for r in rules)
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    ctes = [f"""u as (select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, html, {lower.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0)")} as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
j as (select *, case {fits.replace('{}', '')} end as rule from p),
v as (select *, case {verdict} end as verdict from j),
seeds as (select host, floor(count(*) filter (verdict = 'allow') * {SCALE}::double / count(*))::bigint as trust, floor(count(*) filter (verdict = 'block') * {SCALE}::double / count(*))::bigint as distrust from v where host <> '' group by host),
l as (select host as src, {lower.format('unnest(h)')} as dst from (select host, regexp_extract_all(html, '{link}', 1) as h from p)),
e as (select src, dst, count(*) as w from l where src <> '' and dst <> '' and src <> dst group by src, dst),
b as (select 'trust' as kind, src as host, dst as go, w, sum(w) over (partition by src) as total from e union all select 'distrust', dst, src, w, sum(w) over (partition by dst) from e),
s as (select 'trust' as kind, host, trust as rank from seeds where trust > 0 union all select 'distrust', host, distrust from seeds where distrust > 0),
base as (select kind, host, floor(rank::double * (1 - {DAMPING}::double))::bigint as rank from s)"""]
    prior = "s"
    for k in range(rounds):
        ctes.append(f"r{k} as (select kind, host, sum(rank)::bigint as rank from (select kind, host, rank from base union all select b.kind, b.go, floor({prior}.rank::double * {DAMPING}::double * b.w::double / b.total::double)::bigint from {prior} join b on b.kind = {prior}.kind and b.host = {prior}.host) group by kind, host)")
        prior = f"r{k}"
    return "with " + ",\n".join(ctes) + f""",
bad as (select host from {prior} group by host having coalesce(sum(rank) filter (kind = 'distrust'), 0) > coalesce(sum(rank) filter (kind = 'trust'), 0))
select page_id, host, path, rule, coalesce(verdict, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from v"""
