"""URL filters: explicit rules first, then a path-template tree per host, in DataFrame functions only.

Paths are first reduced to shapes, in which a segment that holds a digit is the wildcard ``*``; the tree
works on the distinct shapes of a host with their counts, so a page-rich host costs no more than a
varied one. At each node, from the root down to the end of every path:

* Variable words: if ``VARIED`` or more of a node's words have fewer than ``LEAST`` rows each, they are
  values of one variable and become the wildcard. Fewer of them keep their names.
* Merging: words of ``LEAST`` rows or more are put in cells by their shares of what follows and of blocked
  labels. Neighbouring cells that a chi-square test doesn't tell apart make a cluster, and the words
  that do not differ from their cluster, by the same test, are merged under the name of the first of
  them. Words with labels and words without any are clustered apart, as nothing speaks for or against
  the latter.
* Purity: (blocked + WEIGHT * prior) / (labelled + WEIGHT). The prior of a node lies between ``PRIOR`` and the
  purity of its parent; the root's parent is the host's domain (its last two names).

A template is rejected if it has labels and its purity reaches ``PURITY``.

Labels: rows that an explicit rule decides, or those that callers give. What a rule says holds for the
path it names: its segments are neither merged nor made wildcards, and nodes above don't count its rows.

Inputs and edge cases: a null url, or one without ``://``, has an empty host and path and belongs to the
template of the empty path; urls are read whole and paths to their end; repeated rows are judged alike
and count as often; null ids are kept; an empty table gives an empty one; only the named columns are
read, so further ones may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: ``(verdict, rule)``; a rule is a host and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEAST, VARIED, CELLS = 3, 20, 4
#: 1 % points of chi-square with one and two degrees of freedom.
CHI1, CHI2 = 6.635, 9.210
#: Share of the parent's purity in a child's prior.
DAMP = 0.5
PRIOR, WEIGHT, PURITY = 0.1, 2.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _kind(segment: Column) -> Column:
    """What follows a branch: 0 nothing, 1 a variable, 2 a word."""
    return F.when(segment.isNull(), 0).when(segment == "*", 1).otherwise(2)


def _chi(seen: list[Column], shares: list[Column]) -> Column:
    """Chi-square of the counts ``seen`` against the counts ``shares`` of a pool, scaled to their sum."""
    n, total = sum(seen[1:], seen[0]), sum(shares[1:], shares[0])
    out = F.lit(0.0)
    for x, y in zip(seen, shares, strict=True):
        expected = F.try_divide(n * y, total)
        out = out + F.when(expected > 0, (x - expected) * (x - expected) / expected).otherwise(0.0)
    return out


FOLLOWS, LABELS = ("k0", "k1", "k2"), ("b", "a")
NODE = ["host", "template"]


def _merged(words: DataFrame) -> DataFrame:
    """``host, template, seg, name`` of words (``n, l, a, b, k0, k1, k2``) that are merged under one name."""

    def share(x: str, n: str) -> Column:
        return F.floor(F.lit(CELLS) * F.col(x) / F.col(n)).cast("int")

    cell = [*NODE, "lab", "cb", "c1", "c2"]
    words = words.withColumn("lab", F.col("l") > 0).withColumn("cb", F.when(F.col("l") > 0, share("b", "l")).otherwise(-1)).withColumn("c1", share("k1", "n")).withColumn("c2", share("k2", "n"))
    cells = words.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in (*FOLLOWS, *LABELS)])
    # At most 2 * (CELLS + 1) ** 3 cells a node.
    order = Window.partitionBy(*NODE, "lab").orderBy("cb", "c1", "c2")

    def apart(names: tuple[str, ...], point: float) -> Column:
        own, before = [F.col(c) for c in names], [F.lag(c).over(order) for c in names]
        both = [x + y for x, y in zip(own, before, strict=True)]
        test = _chi(own, both) + _chi(before, both)
        return F.coalesce(test > point, F.lit(False))

    first = F.lag("cb").over(order).isNull()
    cells = cells.withColumn("new", (first | apart(FOLLOWS, CHI2) | apart(LABELS, CHI1)).cast("int"))
    cells = cells.withColumn("cluster", F.sum("new").over(order))
    pools = cells.groupBy(*NODE, "lab", "cluster").agg(*[F.sum(c).alias(f"p_{c}") for c in (*FOLLOWS, *LABELS)])
    pooled = words.join(cells.select(*cell, "cluster"), cell).join(pools, [*NODE, "lab", "cluster"])

    def fits(names: tuple[str, ...], point: float) -> Column:
        return F.coalesce(_chi([F.col(c) for c in names], [F.col(f"p_{c}") for c in names]) <= point, F.lit(True))

    alike = pooled.where(fits(FOLLOWS, CHI2) & fits(LABELS, CHI1))
    names = alike.groupBy(*NODE, "lab", "cluster").agg(F.min("seg").alias("least"), F.count("*").alias("members")).where("members > 1")
    return alike.join(names, [*NODE, "lab", "cluster"]).select(*NODE, "seg", F.concat(F.lit("{"), F.col("least"), F.lit("}")).alias("name"))


def _purity(labelled: Column, blocked: Column, parent: Column) -> Column:
    prior = F.lit(PRIOR) + F.lit(DAMP) * (parent - F.lit(PRIOR))
    return (blocked + F.lit(WEIGHT) * prior) / (labelled + F.lit(WEIGHT))


def _said(depth: int) -> list[Column]:
    """Labels and blocked labels that hold for a whole node of this depth."""
    return [F.sum(F.when(F.col("fixed") <= depth, F.col(c)).otherwise(0)).alias(name) for c, name in (("l", "sl"), ("b", "sb"))]


def templates(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, shape, fixed, template, own, purity`` of every row of ``host, shape, fixed, n, l, b``.

    ``n, l, b``: rows, labelled rows and blocked ones; ``fixed``: how many segments a rule names;
    ``own``: labelled rows of the template; ``purity``: its smoothed share of blocked ones.
    """
    domain = F.substring_index("host", ".", -2)
    above = shapes.groupBy(domain.alias("_domain")).agg(*_said(0)).select("_domain", _purity(F.col("sl"), F.col("sb"), F.lit(PRIOR)).alias("above"))
    state = shapes.join(above, domain == F.col("_domain")).drop("_domain").withColumn("template", F.lit(""))
    state, ended, depth = scratch.save(state, "urls"), [], 0
    leaf = ["host", "shape", "fixed", "n", "l", "b", "template", "above"]
    while True:
        # ``above`` is the purity of the parent; of nodes that go on, it becomes their own.
        nodes = state.groupBy(*NODE).agg(F.sum("n").alias("rows"), *_said(depth))
        at = state.join(nodes, NODE)
        goes = (F.size("shape") > depth) & (F.col("rows") >= LEAST)
        rest = F.when(F.size("shape") > depth, F.concat(F.lit("/"), F.array_join(F.slice("shape", depth + 1, F.greatest(F.size("shape") - depth, F.lit(0))), "/"))).otherwise("")
        ended.append(scratch.save(at.where(~goes).withColumn("template", F.concat("template", rest)).select(*leaf), "ended"))
        at = at.where(goes).withColumn("above", _purity(F.col("sl"), F.col("sb"), F.col("above"))).drop("rows", "sl", "sb")
        at = scratch.save(at.withColumn("seg", F.get("shape", F.lit(depth))).withColumn("next", _kind(F.get("shape", F.lit(depth + 1)))), "level")
        if at.isEmpty():
            break
        words = at.where("seg <> '*'").groupBy(*NODE, "seg").agg(
            F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.max(F.col("fixed") > depth).alias("named"), *[F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(3)]
        )
        words = scratch.save(words.where("not named").withColumn("a", F.col("l") - F.col("b")), "words")
        rare = words.where(F.col("n") < LEAST)
        varied = rare.groupBy(*NODE).agg(F.count("*").alias("rares")).where(F.col("rares") >= VARIED).select(*NODE)
        names = _merged(words.where(F.col("n") >= LEAST)).union(rare.join(varied, NODE).select(*NODE, "seg", F.lit("*")))
        step = at.join(names, [*NODE, "seg"], "left").withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", "seg")))
        state = scratch.save(step.select(*leaf), "urls")
        depth += 1
    out = ended[0]
    for df in ended[1:]:
        out = out.union(df)
    # Shapes that end in one template share their parents, but for those that few rows reach: the least purity counts.
    parts = [F.sum("l").alias("own"), F.sum("b").alias("blocked"), F.min("above").alias("prior")]
    pure = out.groupBy(*NODE).agg(*parts).select(*NODE, "own", _purity(F.col("own"), F.col("blocked"), F.col("prior")).alias("purity"))
    return out.join(pure, NODE).select("host", "shape", "fixed", "template", "own", "purity")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labels: Column | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row.

    ``labels``: a column of ``pages`` with 1 for blocked, 0 for allowed, else null; by default the rows
    that a rule decides.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.lit(None) if labels is None else labels).cast("int").alias("label"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    fixed = F.lit(0)
    if labels is None:
        rows = rows.withColumn("label", F.when(F.col("rule").isNotNull(), (verdict_of(F.col("rule"), rules) == "block").cast("int")))
        fixed = F.coalesce(F.size(F.filter(F.split(F.regexp_extract("rule", "(?s)/(.*)$", 1), "/"), lambda x: x != "")), F.lit(0))
        fixed = F.when(F.col("rule").isNull(), 0).otherwise(fixed)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = rows.withColumn("fixed", fixed)
    rows = rows.withColumn("shape", F.transform(segments, lambda x, k: F.when((k >= F.col("fixed")) & x.rlike("[0-9]"), "*").otherwise(x)))
    shapes = rows.groupBy("host", "shape", "fixed").agg(F.count("*").alias("n"), F.count("label").alias("l"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    known = scratch.save(templates(scratch.save(shapes, "shapes"), scratch), "templates")
    out = rows.join(known, ["host", "shape", "fixed"])
    tree = F.when((F.col("own") > 0) & (F.col("purity") >= PURITY), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), tree).alias("verdict"), "template", "purity")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


#: Levels of the tree that the SQL reads; paths of the test tables have two segments.
SQL_LEVELS = 4


def _sql_chi(seen: list[str], shares: list[str]) -> str:
    n, total = f"({' + '.join(seen)})", f"nullif({' + '.join(shares)}, 0)"
    terms = [f"(CASE WHEN {n} * {y} / {total} > 0 THEN ({x} - {n} * {y} / {total}) * ({x} - {n} * {y} / {total}) / ({n} * {y} / {total}) ELSE 0 END)" for x, y in zip(seen, shares, strict=True)]
    return "(0.0::DOUBLE + " + " + ".join(terms) + ")"


def op8_sql() -> str:
    """DuckDB SQL for ``op8_urls``."""
    fits = {r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))" for _, r in RULES}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r in sorted(fits, key=lambda r: (-len(r), r))) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES) + " END"
    fixed = "CASE " + " ".join(f"WHEN rule = '{r}' THEN {len([x for x in r.partition('/')[2].split('/') if x])}" for _, r in RULES) + " ELSE 0 END"

    def purity(labelled: str, blocked: str, parent: str) -> str:
        return f"(({blocked}) + {WEIGHT}::DOUBLE * ({PRIOR}::DOUBLE + {DAMP}::DOUBLE * (({parent}) - {PRIOR}::DOUBLE))) / (({labelled}) + {WEIGHT}::DOUBLE)"

    def said(depth: int) -> str:
        return ", ".join(f"sum(CASE WHEN fixed <= {depth} THEN {c} ELSE 0 END)::DOUBLE AS s{c}" for c in "lb")

    follows, labels = list(FOLLOWS), list(LABELS)
    every = [*follows, *labels]
    domain = "array_to_string(string_split(host, '.')[-2:], '.')"
    steps = [
        f"raw AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"ruled AS (SELECT *, {rule} AS rule FROM raw)",
        f"pagerows AS (SELECT *, CASE WHEN rule IS NOT NULL THEN CASE WHEN {verdict} = 'block' THEN 1 ELSE 0 END END AS label, {fixed} AS fixed, [CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END FOR x IN string_split(path, '/') IF x <> ''] AS shape FROM ruled)",
        "shapes AS (SELECT host, shape, fixed, count(*) AS n, count(label) AS l, coalesce(sum(label), 0)::BIGINT AS b FROM pagerows GROUP BY ALL)",
        f"above AS (SELECT d, {purity('sl', 'sb', f'{PRIOR}::DOUBLE')} AS above FROM (SELECT {domain} AS d, {said(0)} FROM shapes GROUP BY ALL))",
        f"state0 AS (SELECT host, shape, fixed, n, l, b, '' AS template, above FROM shapes JOIN above ON {domain} = d)",
    ]
    for d in range(SQL_LEVELS):
        before = [f"lag({c}) OVER w" for c in every]
        both = [f"({c} + lag({c}) OVER w)" for c in every]

        def apart(part: slice, point: float) -> str:
            own, prev, pool = every[part], before[part], both[part]  # noqa: B023
            return f"coalesce({_sql_chi(own, pool)} + {_sql_chi(prev, pool)} > {point}, false)"

        def like(part: slice, point: float) -> str:
            return f"coalesce({_sql_chi(every[part], [f'p_{c}' for c in every[part]])} <= {point}, true)"

        steps += [
            f"nodes{d} AS (SELECT host, template, sum(n) AS node_rows, {said(d)} FROM state{d} GROUP BY ALL)",
            f"in{d} AS (SELECT s.*, node_rows, sl, sb, len(shape) > {d} AND node_rows >= {LEAST} AS goes FROM state{d} s JOIN nodes{d} USING (host, template))",
            f"ended{d} AS (SELECT host, shape, fixed, n, l, b, template || CASE WHEN len(shape) > {d} THEN '/' || array_to_string(shape[{d + 1}:], '/') ELSE '' END AS template, above FROM in{d} WHERE NOT goes)",
            f"at{d} AS (SELECT host, shape, fixed, n, l, b, template, {purity('sl', 'sb', 'above')} AS above, shape[{d + 1}] AS seg, CASE WHEN len(shape) <= {d + 1} THEN 0 WHEN shape[{d + 2}] = '*' THEN 1 ELSE 2 END AS nxt FROM in{d} WHERE goes)",
            f"""words{d} AS (SELECT *, l - b AS a FROM (SELECT host, template, seg, sum(n)::BIGINT AS n, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b, max(fixed) > {d} AS named, {', '.join(f'sum(CASE WHEN nxt = {k} THEN n ELSE 0 END)::BIGINT AS k{k}' for k in range(3))}
  FROM at{d} WHERE seg <> '*' GROUP BY host, template, seg) WHERE NOT named)""",
            f"often{d} AS (SELECT *, l > 0 AS lab, CASE WHEN l > 0 THEN floor({CELLS} * b / l) ELSE -1 END AS cb, floor({CELLS} * k1 / n) AS c1, floor({CELLS} * k2 / n) AS c2 FROM words{d} WHERE n >= {LEAST})",
            f"cells{d} AS (SELECT host, template, lab, cb, c1, c2, {', '.join(f'sum({c})::BIGINT AS {c}' for c in every)} FROM often{d} GROUP BY ALL)",
            f"""cut{d} AS (SELECT *, sum(fresh) OVER w AS cluster FROM (SELECT *, CASE WHEN lag(cb) OVER w IS NULL OR {apart(slice(0, 3), CHI2)} OR {apart(slice(3, 5), CHI1)} THEN 1 ELSE 0 END AS fresh
  FROM cells{d} WINDOW w AS (PARTITION BY host, template, lab ORDER BY cb, c1, c2)) WINDOW w AS (PARTITION BY host, template, lab ORDER BY cb, c1, c2))""",
            f"pools{d} AS (SELECT host, template, lab, cluster, {', '.join(f'sum({c})::BIGINT AS p_{c}' for c in every)} FROM cut{d} GROUP BY ALL)",
            f"""alike{d} AS (SELECT * FROM often{d} o JOIN (SELECT host, template, lab, cb, c1, c2, cluster FROM cut{d}) c USING (host, template, lab, cb, c1, c2) JOIN pools{d} p USING (host, template, lab, cluster)
  WHERE {like(slice(0, 3), CHI2)} AND {like(slice(3, 5), CHI1)})""",
            f"names{d} AS (SELECT host, template, lab, cluster, min(seg) AS least FROM alike{d} GROUP BY ALL HAVING count(*) > 1)",
            f"""called{d} AS (SELECT host, template, seg, '{{' || least || '}}' AS name FROM alike{d} JOIN names{d} USING (host, template, lab, cluster)
  UNION ALL SELECT w.host, w.template, w.seg, '*' FROM words{d} w JOIN (SELECT host, template FROM words{d} WHERE n < {LEAST} GROUP BY ALL HAVING count(*) >= {VARIED}) v USING (host, template) WHERE w.n < {LEAST})""",
            f"state{d + 1} AS (SELECT s.host, s.shape, s.fixed, s.n, s.l, s.b, s.template || '/' || coalesce(k.name, s.seg) AS template, s.above FROM at{d} s LEFT JOIN called{d} k ON s.host = k.host AND s.template = k.template AND s.seg = k.seg)",
        ]
    steps += [
        "final AS (" + " UNION ALL ".join(f"SELECT * FROM ended{d}" for d in range(SQL_LEVELS)) + f" UNION ALL SELECT * FROM state{SQL_LEVELS})",
        f"pure AS (SELECT host, template, own, {purity('own', 'blocked', 'prior')} AS purity FROM (SELECT host, template, sum(l)::DOUBLE AS own, sum(b)::DOUBLE AS blocked, min(above) AS prior FROM final GROUP BY ALL))",
        "known AS (SELECT DISTINCT f.host, f.shape, f.fixed, f.template, own, purity FROM final f JOIN pure USING (host, template))",
    ]
    return "WITH " + ", ".join(steps) + f" SELECT r.page_id, r.host, r.path, r.rule, coalesce({verdict}, CASE WHEN own > 0 AND purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM pagerows r JOIN known k ON r.host = k.host AND r.shape = k.shape AND r.fixed = k.fixed"
