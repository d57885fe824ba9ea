"""Merkle manifest of a dataset: leaves by source, runs of 16 nodes folded level by level to a subroot per source, the subroots
likewise to one root; and proofs, climbed by a recursive query.

Built levels are stored as rows of runs: the digests of up to 16 members, the digest over them, and the run (with the place in
it) that this one is a member of. The recursive query starts at the runs of leaves, whose leaves share all that lies above them,
and climbs from run to parent run: it folds the digest of every leaf upward and appends the siblings met on the way.

Everything is a DataFrame or SQL expression. Places within a source come from a range partitioning with offsets per partition,
so no window and no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import stage

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOP = -1  # the tree of the subroots


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the values one after another: `-` for null, else count of UTF-8 bytes, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def tampering(doc_id: str = "doc_id") -> Column:
    """Rows whose text is tampered with: the unsigned CRC-32 of the decimal id is divisible by 5. A null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def placed(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The staged rows with `part` and `line`, and per (group, part) the `first` line, the rows `before` it in other parts and
    the group's `size`: a row's place in its group by the order is line - first + before."""
    sorted_ = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = stage(sorted_.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
                 name)
    counts = rows.groupBy(*group, "part").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, counts.select(*group, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                               F.sum("n").over(whole).alias("size"))


def _runs_above(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of 16 consecutive nodes (tree, size, pos, digest) of a level; a tree of one node has none."""
    return (nodes.where("size > 1").groupBy("tree", "size", F.expr(f"pos DIV {ARITY}").alias("run"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("held"))
            .select("tree", F.lit(level).alias("level"), "run", F.expr(f"CAST(ceil(size / {ARITY}) AS BIGINT)").alias("size"),
                    F.col("held.digest").alias("members"), F.sha2(F.concat_ws("", "held.digest"), 256).alias("digest")))


def levels(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Staged runs per level, from the leaves (tree, size, pos, digest) up; `most` is the size of the largest tree."""
    built: list[DataFrame] = []
    while most > 1:
        built.append(stage(_runs_above(nodes, len(built)), f"{name}-{len(built)}"))
        nodes = built[-1].select("tree", "size", F.col("run").alias("pos"), "digest")
        most = -(-most // ARITY)
    return built


def _linked(runs: DataFrame, many: bool) -> DataFrame:
    """Runs with the run they are members of and their place there. The last run of a source's tree is a member of a run of
    subroots if there are many sources; the last run of all has no parent."""
    last, top = F.col("size") == 1, F.col("tree") == TOP
    up = last & ~top if many else F.lit(False)
    end = last & (top | F.lit(not many))
    return runs.select("tree", "level", "run", "members", "digest",
                       F.when(end, None).when(up, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"),
                       F.when(end, None).when(up, F.lit(0)).otherwise(F.col("level") + 1).cast("int").alias("up_level"),
                       F.when(end, None).when(up, F.expr(f"tree DIV {ARITY}")).otherwise(F.expr(f"run DIV {ARITY}")).alias("up_run"),
                       F.when(end, None).when(up, F.col("tree") % ARITY).otherwise(F.col("run") % ARITY).cast("int").alias("up_at"))


CLIMB = """
WITH RECURSIVE climb(tree, run, up_tree, up_level, up_run, up_at, folded, above, digest, subroot) AS (
  SELECT tree, run, up_tree, up_level, up_run, up_at, folded, '' AS above, digest, subroot FROM {anchors}
  UNION ALL
  SELECT c.tree, c.run, r.up_tree, r.up_level, r.up_run, r.up_at,
    transform(c.folded, f -> sha2(concat(array_join(slice(r.members, 1, c.up_at), ''), f,
                                         array_join(slice(r.members, c.up_at + 2, {arity}), '')), 256)),
    concat(c.above, array_join(slice(r.members, 1, c.up_at), ''), array_join(slice(r.members, c.up_at + 2, {arity}), '')),
    r.digest, if(r.tree >= 0 AND coalesce(r.up_tree, -1) < 0, r.digest, c.subroot)
  FROM climb c JOIN {runs} r ON r.tree = c.up_tree AND r.level = c.up_level AND r.run = c.up_run)
SELECT tree, run, folded, above, digest AS root, subroot FROM climb WHERE up_tree IS NULL
"""


def climbed(spark: SparkSession, anchors: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of anchors at the root: folded digests, appended siblings, root, subroot. Spark bounds the rows of a recursion by
    default; every level has a row per anchor here, so the bound is lifted while the climb is made and staged."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return stage(spark.sql(CLIMB.replace("{arity}", str(ARITY)), anchors=anchors, runs=runs), "manifest-climb")
    finally:
        spark.conf.set(key, old)


def verified(docs: DataFrame) -> DataFrame:
    """One row per document: leaf, subroot of its source, root, hash of its proof's siblings, the root folded from its tampered
    (else original) leaf, and whether that is the root.

    Null values are part of a leaf (`-`); a null source is the first source, null ids come first in a source. Equal ids are
    ordered by leaf and tampered leaf, so repeated rows are leaves each. A source of one document has its leaf as subroot, a
    table of one source its subroot as root, a table of one document its leaf as root and an empty proof. An empty table
    gives no rows. Texts of any length are hashed whole. Other columns are not read.
    """
    spark = docs.sparkSession
    types = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    rows = docs.select(*[F.col(c).cast(types[c]).alias(c) for c in COLUMNS])
    own = [F.col(c) for c in COLUMNS]
    changed = [F.translate("text", UPPER, UPPER.lower()) if c == "text" else F.col(c) for c in COLUMNS]
    leaves = stage(rows.select("doc_id", "source", leaf_digest(own).alias("leaf"),
                               F.when(tampering(), leaf_digest(changed)).alias("tampered")), "manifest-leaves")

    lines, offsets = placed(leaves, ["source"], ["doc_id", "leaf", "tampered"], "manifest-lines")
    names, name_offsets = placed(offsets.groupBy("source").agg(F.first("size").alias("size")), [], ["source"], "manifest-sources")
    trees = names.join(name_offsets.drop("size"), "part").select("source", "size", (F.col("line") - F.col("first") + F.col("before")).alias("tree"))
    trees = stage(trees, "manifest-trees")
    sources, largest = trees.agg(F.count("*"), F.max("size")).first()
    if not sources:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")

    offsets = (offsets.alias("o").join(trees.alias("t"), F.expr("o.source <=> t.source"))
               .select("o.source", "o.part", "o.first", "o.before", "t.tree", "t.size"))
    nodes = stage(lines.alias("l").join(offsets.alias("o"), F.expr("o.part = l.part AND o.source <=> l.source"))
                  .select("o.tree", "o.size", F.expr("l.line - o.first + o.before").alias("pos"), "l.doc_id", "l.leaf", "l.tampered"),
                  "manifest-nodes")
    built = levels(nodes.withColumnRenamed("leaf", "digest"), largest, "manifest-runs")
    lone = nodes.where("size = 1").select("tree", F.lit(1).cast("long").alias("size"), F.col("leaf").alias("digest"))
    subroots = lone.select("tree", "digest")
    for runs in built:
        subroots = subroots.union(runs.where("size = 1").select("tree", "digest"))
    many = sources > 1
    top = levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(sources).cast("long").alias("size"), F.col("tree").alias("pos"),
                                 "digest"), sources, "manifest-top")

    # The start: leaves of a run in order (a lone leaf is a run of its own without siblings), each folded into the run's digest.
    starts = _linked(lone.select("tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("run"), "size",
                                 F.array("digest").alias("members"), "digest"), many).withColumn("lone", F.lit(True))
    if built:
        starts = starts.unionByName(_linked(built[0], many).withColumn("lone", F.lit(False)))
    leaf = F.struct("pos", "doc_id", "leaf", F.coalesce("tampered", "leaf").alias("start"))
    held = nodes.groupBy("tree", F.expr(f"pos DIV {ARITY}").alias("run")).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    folded = F.expr(f"""transform(leaves, (x, i) -> if(lone, x.start, sha2(concat(
        array_join(slice(members, 1, i), ''), x.start, array_join(slice(members, i + 2, {ARITY}), '')), 256)))""")
    anchors = stage(held.join(starts, ["tree", "run"])
                    .select("tree", "run", "leaves", "members", "up_tree", "up_level", "up_run", "up_at", folded.alias("folded"), "digest",
                            F.when(F.coalesce("up_tree", F.lit(TOP)) == TOP, F.col("digest")).alias("subroot")), "manifest-anchors")
    runs = starts.drop("lone").where("false")  # a table of lone leaves has no other runs than these
    for level in [*built[1:], *top]:
        runs = runs.unionByName(_linked(level, many))
    ends = climbed(spark, anchors.drop("leaves", "members"), runs)

    each = (anchors.select("tree", "run", "leaves", "members").join(ends, ["tree", "run"])
            .select("members", "folded", "above", "root", "subroot", F.posexplode("leaves").alias("i", "x")))
    siblings = F.expr(f"concat(array_join(slice(members, 1, i), ''), array_join(slice(members, i + 2, {ARITY}), ''), above)")
    out = each.select("x.doc_id", "x.leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                      F.expr("element_at(folded, i + 1)").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def verified_sql(docs: str = "documents") -> str:
    """SQL of `verified`; CRC-32 is taken bit by bit over the digits of the id."""
    def digest(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(s, d), range(8)), lambda c, z: {step})"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda s, d: {byte}), 4294967295::BIGINT)"
    up = f"pos // {ARITY}"
    return f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, source, {digest('text')} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {digest(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {digest('text')} END AS start
  FROM {docs}),
tree AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS size FROM leaf GROUP BY source),
placed AS (SELECT row_number() OVER () AS r, doc_id, leaf, start, tree, size, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, start) - 1 AS pos
           FROM leaf JOIN tree ON leaf.source IS NOT DISTINCT FROM tree.source),
grown(tree, level, size, pos, digest) AS (
  SELECT tree, 0, size, pos, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, (size + {ARITY - 1}) // {ARITY}, {up}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM grown WHERE size > 1 GROUP BY tree, level, size, {up}),
crown(level, size, pos, digest) AS (
  SELECT 0, (SELECT count(*) FROM tree), tree, digest FROM grown WHERE size = 1
  UNION ALL
  SELECT level + 1, (size + {ARITY - 1}) // {ARITY}, {up}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM crown WHERE size > 1 GROUP BY level, size, {up}),
height AS (SELECT tree, max(level) AS height FROM grown GROUP BY tree),
node AS (SELECT tree, level, size, pos, digest FROM grown WHERE size > 1
         UNION ALL SELECT {TOP}, level, size, pos, digest FROM crown WHERE size > 1),
run AS (SELECT tree, level, {up} AS run, list(digest ORDER BY pos) AS members FROM node GROUP BY tree, level, {up}),
climb(r, step, tree, own, level, pos, folded, siblings) AS (
  SELECT r, 0, CASE WHEN size = 1 THEN {TOP} ELSE tree END, tree, 0, CASE WHEN size = 1 THEN tree ELSE pos END, start, ''
  FROM placed
  UNION ALL
  SELECT r, step + 1, CASE WHEN c.tree >= 0 AND c.level + 1 = height THEN {TOP} ELSE c.tree END, own,
    CASE WHEN c.tree >= 0 AND c.level + 1 = height THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.tree >= 0 AND c.level + 1 = height THEN own ELSE {up} END,
    sha256(array_to_string(members[:pos % {ARITY}], '') || folded || array_to_string(members[pos % {ARITY} + 2:], '')),
    siblings || array_to_string(members[:pos % {ARITY}], '') || array_to_string(members[pos % {ARITY} + 2:], '')
  FROM climb c JOIN height h ON h.tree = own JOIN run ON run.tree = c.tree AND run.level = c.level AND run.run = {up}),
ended AS (SELECT r, max_by(folded, step) AS folded_root, max_by(siblings, step) AS siblings FROM climb GROUP BY r)
SELECT doc_id, leaf, g.digest AS subroot, c.digest AS root, sha256(siblings) AS proof_sha256, folded_root, folded_root = c.digest AS verified
FROM placed JOIN ended USING (r) JOIN grown g ON g.tree = placed.tree AND g.size = 1, crown c WHERE c.size = 1"""
