"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source).  A token budget flows down from the root: at each node it is
shared among the children by weight, none getting more than its subtree can give (its tokens times
max_epochs); what a child cannot use goes to its siblings by weight, and only what the whole subtree
cannot use was never given to it by its parent.  Each share is found in closed form: children are
sorted by capacity over weight; those that fill up before the common level get their capacity, the
rest floor(weight * what is left / their weights).

A leaf's documents are taken in the order of md5(seed:epoch:doc_id), epoch after epoch, as long as
the tokens before a document are fewer than the leaf's budget: whole epochs first, then a prefix.
The prefix is found without ordering a leaf: tokens are summed by the order key's first hex digits,
running sums over these buckets find the one where the budget ends, and its rows are summed by their next
digits, until no leaf's bucket holds more than `bucket_rows` rows; only these are ordered.

Tokens of a document are its words [^\\x20\\x09-\\x0D]+ (null or empty: none).  Documents without tokens
take no budget and are never chosen, as nothing of them could be used.  Null languages and sources are
names of their own.  Rows that repeat an id share their order key and stay together: both are
chosen or neither.  A source outside the weights has weight 1; a weight of 0 gives nothing.  An empty
table gives an empty one.  Other columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalstream.llm.common import Tables


@dataclass(frozen=True)
class Mix:
    """Integer weights by name at each level; per cent of the corpus's tokens to choose."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 5, "books": 3, "code": 1, "forum": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 2, "src1": 3})
    domain_names: tuple[str, ...] = ("web", "books", "code", "forum")  # of a source, by the number in its name
    percent: int = 90
    max_epochs: int = 2
    seed: int = 20240501
    bucket_digits: int = 2
    bucket_rows: int = 1000


DIGITS = 12  # of the md5 that order by: 48 bits; doc_id breaks ties


def domain_of(source: Column, names: tuple[str, ...]) -> Column:
    number = F.coalesce(F.expr("0"), F.lit(0))
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int"), number)
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def _weight(name: Column, table: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in table.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("decimal(38,0)")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent columns, name, w, cap, have: the parent's budget) with budget; exact whole numbers."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # cap_i / w_i ascending without division: compare cap_i * W / w_i is not exact, so order by the exact quotient and remainder
    nodes = nodes.filter("w > 0 and cap > 0").withColumn("q", F.expr("cap div w")).withColumn("r", F.expr("cast(cap % w as double) / cast(w as double)"))
    order = by.orderBy("q", "r", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    nodes = nodes.withColumn("used", F.coalesce(F.sum("cap").over(before), zero).cast("decimal(38,0)")).withColumn("rest_w", F.sum("w").over(from_here).cast("decimal(38,0)"))
    nodes = nodes.withColumn("left", F.greatest(F.expr("have - used"), zero).cast("decimal(38,0)"))
    nodes = nodes.withColumn("fills", F.expr("cap * rest_w <= left * w").cast("int"))
    # the first child in order that doesn't fill sets the level for all after it
    first = by.orderBy("fills", "q", "r", "name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level_left, level_w = F.first("left").over(first), F.first("rest_w").over(first)
    nodes = nodes.withColumn("ll", level_left).withColumn("lw", level_w)
    return nodes.withColumn("budget", F.expr("case when fills = 1 then cap else least(cap, (ll * w) div lw) end").cast("long"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) to those with budget; the tree is as small as its configuration."""
    dec = lambda c: F.expr(f"cast({c} as decimal(38,0))")
    leaves = leaves.filter("tokens > 0").withColumn("cap", (F.col("tokens") * mix.max_epochs).cast("decimal(38,0)"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select(F.expr(f"cast((t * {mix.percent}) div 100 as decimal(38,0))").alias("have"))
    domains = leaves.groupBy("domain").agg(dec("sum(cap)").alias("cap")).crossJoin(F.broadcast(total))  # one row
    domains = share(domains.select("domain", F.col("domain").alias("name"), _weight(F.col("domain"), mix.domains).alias("w"), "cap", "have"), [])
    langs = leaves.groupBy("domain", "lang").agg(dec("sum(cap)").alias("cap")).join(domains.select("domain", F.col("budget").cast("decimal(38,0)").alias("have")), "domain")
    langs = share(langs.select("domain", "lang", F.col("lang").alias("name"), _weight(F.col("lang"), mix.languages).alias("w"), "cap", "have"), ["domain"])
    sources = leaves.join(langs.select("domain", "lang", F.col("budget").cast("decimal(38,0)").alias("have")), ["domain", "lang"])
    sources = share(sources.select("domain", "lang", "source", F.col("source").alias("name"), _weight(F.col("source"), mix.sources).alias("w"), "cap", "tokens", "have"), ["domain", "lang"])
    return sources.select("domain", "lang", "source", "tokens", "budget").withColumn("whole", F.expr("budget div tokens")).withColumn("part", F.expr("budget % tokens"))


def tokens_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+, counted inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, mix: Mix) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")))), 1, DIGITS)


def choose(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of docs chosen, each under `doc` (all its columns), once per epoch it is used in, with
    domain, lang, source (names, null as '-'), tokens, epoch."""
    mix = mix or Mix()
    spark = docs.sparkSession
    tables = Tables(spark, "mix")
    name = lambda c: F.coalesce(F.col(c), F.lit("-"))
    rows = docs.select(F.struct("*").alias("doc")).select("doc", domain_of(F.col("doc.source"), mix.domain_names).alias("domain"), name("doc.lang").alias("lang"), name("doc.source").alias("source"), tokens_of(F.col("doc.text")).alias("tokens"))
    slim = tables.write(rows.select(F.col("doc.doc_id").alias("doc_id"), "domain", "lang", "source", "tokens"), "tokens")
    leaf = ["domain", "lang", "source"]
    budgets = tables.write(leaf_budgets(slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), mix), "budgets")
    # where each leaf's last, partial epoch ends
    part = budgets.filter("part > 0").select(*leaf, "whole", "part")
    keyed = slim.filter("tokens > 0").join(part, leaf).withColumn("key", order_key(F.col("doc_id"), F.col("whole"), mix))
    run = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside, edge, digits = keyed.withColumn("before", F.lit(0).cast("long")), None, 0
    while digits < DIGITS:
        digits += mix.bucket_digits
        sums = inside.withColumn("bucket", F.substring("key", 1, digits)).groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.first("part").alias("part"), F.first("before").alias("start"))
        at = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("t").over(run), F.lit(0)))
        old = edge
        edge = tables.write(at.filter("before < part and before + t >= part").select(*leaf, F.col("bucket").alias("edge"), "before", "n"), f"edges{digits}")
        tables.drop(old)
        inside = keyed.join(edge.drop("n"), leaf).filter(F.substring("key", 1, digits) == F.col("edge"))
        if (edge.agg(F.max("n")).first()[0] or 0) <= mix.bucket_rows:
            break
    inside = inside.groupBy(*leaf, "key", "doc_id", "before", "part").agg(F.sum("tokens").alias("t"))
    within = Window.partitionBy(*leaf).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("t").over(within), F.lit(0))).filter("at < part")
    last = last.groupBy(*leaf).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    plan = tables.write(budgets.select(*leaf, "whole", "part").join(last, leaf, "left"), "plan")
    tables.drop(slim, budgets, edge)
    rows = rows.filter("tokens > 0").join(plan, leaf)
    mine = F.struct(order_key(F.col("doc.doc_id"), F.col("whole"), mix).alias("key"), F.col("doc.doc_id").alias("doc_id"))
    uses = F.col("whole") + F.when((F.col("part") > 0) & (mine <= F.col("last")), 1).otherwise(0)
    rows = rows.withColumn("uses", uses).filter("uses > 0")
    return rows.select("doc", *leaf, "tokens", F.explode(F.expr("sequence(0, cast(uses - 1 as int))")).alias("epoch"))


def mixing_digest(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    out = choose(docs, mix)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "domain", "lang", "source", "tokens", F.col("epoch").cast("long").alias("epoch"))


def oracle(mix: Mix | None = None) -> str:
    """DuckDB SQL for mixing_digest over documents."""
    m = mix or Mix()
    case = lambda c, t: "case " + " ".join(f"when {c} = '{k}' then {v}" for k, v in t.items()) + " else 1 end"

    def level(src: str, parent: str) -> str:
        by, comma = (f"partition by {parent}", f"{parent}, ") if parent else ("", "")
        return f"""(select *, (case when fills then cap else least(cap, (ll * w) // lw) end)::bigint as budget from (
  select *, first_value(lft) over z as ll, first_value(rest_w) over z as lw from (
   select *, cap * rest_w <= lft * w as fills from (
    select *, greatest(have - used, 0::hugeint) as lft from (
     select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::hugeint as used,
      sum(w) over (o rows between current row and unbounded following)::hugeint as rest_w
     from (select *, cap // w as q, (cap % w)::double / w::double as r from ({src}) where w > 0 and cap > 0)
     window o as ({by} order by q, r, name)))) window z as ({by} order by fills, q, r, name)))""".replace("{comma}", comma)

    names = ", ".join(f"'{x}'" for x in m.domain_names)
    return f"""
with d as (select doc_id, coalesce(lang, '-') as lang, coalesce(source, '-') as source,
  list_extract([{names}], (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') as bigint), 0) % {len(m.domain_names)} + 1)::int) as domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, (sum(tokens) * {m.max_epochs})::hugeint as cap from d group by all having sum(tokens) > 0),
doms as {level(f"select domain, domain as name, {case('domain', m.domains)}::hugeint as w, sum(cap)::hugeint as cap, (select (sum(tokens) * {m.percent}) // 100 from leaves)::hugeint as have from leaves group by domain", "")},
langs as {level(f"select l.domain, l.lang, l.lang as name, {case('l.lang', m.languages)}::hugeint as w, sum(l.cap)::hugeint as cap, max(p.budget)::hugeint as have from leaves l join doms p using (domain) group by l.domain, l.lang", "domain")},
srcs as {level(f"select l.domain, l.lang, l.source, l.source as name, {case('l.source', m.sources)}::hugeint as w, l.cap, l.tokens, p.budget::hugeint as have from leaves l join langs p using (domain, lang)", "domain, lang")},
plan as (select domain, lang, source, budget // tokens as whole, budget % tokens as part from srcs),
k as (select d.*, whole, part, substring(md5('{m.seed}:' || whole || ':' || doc_id), 1, {DIGITS}) as key from d join plan using (domain, lang, source) where tokens > 0),
c as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before from k),
u as (select *, whole + (before < part)::int as uses from c)
select doc_id, domain, lang, source, tokens, unnest(range(0, uses::bigint)) as epoch from u where uses > 0"""
