"""Pairs, matrices, contacts and kernels over ensembles and structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import ATOM, MEMB, atoms, members, with_
from ..operators import geometry, kernels, pairs
from .projecting import NAMED, UNKNOWN, _named
from .registry import query, r, rounded

CARRY = ["score", "seed", "weight"]


def _pairs(spark, sf):
    return pairs.pair_similarity(members(spark, sf), "g", "id", "contacts", CARRY)


@query(with_(MEMB, "SELECT g, a, b, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, n_both::BIGINT AS n_both, round(jaccard, 6) AS jaccard, jaccard IS NOT NULL AS valid, CASE WHEN n_a = 0 AND n_b = 0 THEN 'both_empty' WHEN n_a = 0 THEN 'first_empty' WHEN n_b = 0 THEN 'second_empty' ELSE '' END AS reason FROM prs"))
def pair_jaccard(spark, sf):
    return rounded(_pairs(spark, sf).select("g", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "n_a", "n_b", "n_both", "jaccard", "valid", "reason"))


SIDE = "(SELECT x.g, x.id AS a, y.id AS b, CASE WHEN len(x.s) > 0 AND len(y.s) > 0 THEN len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE END AS j FROM {t} x JOIN {t} y ON x.g = y.g AND x.id < y.id)"


@query(with_(MEMB, ", sa AS (SELECT m.g, m.id, coalesce(list(DISTINCT ra) FILTER (ra IS NOT NULL), []) AS s FROM memb m LEFT JOIN con USING (g, id) GROUP BY ALL), sb AS (SELECT m.g, m.id, coalesce(list(DISTINCT rb) FILTER (rb IS NOT NULL), []) AS s FROM memb m LEFT JOIN con USING (g, id) GROUP BY ALL)\nSELECT p.g, p.a, p.b, round(p.j, 6) AS side_a, round(q.j, 6) AS side_b, round((p.j + q.j) / 2, 6) AS sides FROM " + SIDE.format(t="sa") + " p JOIN " + SIDE.format(t="sb") + " q ON p.g = q.g AND p.a = q.a AND p.b = q.b").replace("y.id AND s.g = x.g)\n,", "y.id AND s.g = x.g),"))
def pair_side_jaccard(spark, sf):
    return rounded(_pairs(spark, sf).select("g", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("jaccard_side_a").alias("side_a"), F.col("jaccard_side_b").alias("side_b"), F.col("jaccard_sides").alias("sides")))


DIR = ", dir AS (SELECT g, a AS id, b AS other, seed_a AS seed, seed_b AS oseed, weight_a AS weight, weight_b AS oweight, jaccard FROM prs UNION ALL SELECT g, b, a, seed_b, seed_a, weight_b, weight_a, jaccard FROM prs)"


FEAT = """SELECT d.g, d.id, round(avg(jaccard), 6) AS mean_j, round(median(jaccard), 6) AS median_j,
  round(list_avg((list(jaccard ORDER BY jaccard DESC) FILTER (jaccard IS NOT NULL))[1:3]), 6) AS top3_j,
  round(avg(jaccard) FILTER (d.weight = oweight AND d.seed <> oseed), 6) AS mean_j_across_seeds,
  round(avg(jaccard) FILTER (d.weight <> oweight AND d.seed = oseed), 6) AS mean_j_across_weights,
  round(avg(jaccard) FILTER (d.weight <> oweight), 6) AS mean_j_other_weights, round(max(jaccard), 6) AS max_j,
  round(avg((jaccard IS NOT NULL)::INT), 6) AS valid_share, count(jaccard) AS valid_pairs,
  round(sum(jaccard * m.score) / nullif(sum(jaccard), 0), 6) AS weighted_score, round(sum(jaccard * (m.id % 97)) / nullif(sum(jaccard), 0), 6) AS weighted_second,
  round(avg(CASE WHEN jaccard IS NOT NULL THEN abs(d.id - d.other) % 13 END), 6) AS mean_rmsd, round(avg(CASE WHEN (d.id + d.other) % 3 > 0 THEN jaccard END), 6) AS mean_j_cb8, count(*) AS pairs
FROM dir d JOIN memb m ON m.g = d.g AND m.id = d.other GROUP BY d.g, d.id"""


@query(with_(MEMB + DIR, FEAT))
def pair_features(spark, sf):
    """A remainder of the ids stands for the distance of two poses, and a third of the pairs have no representative atoms."""
    m = members(spark, sf).withColumn("second", F.expr("cast(id % 97 as double)"))
    p = pairs.pair_similarity(m, "g", "id", "contacts", [*CARRY, "second"])
    p = p.withColumns({"rmsd": F.when(F.col("jaccard").isNotNull(), F.abs(F.col("a_id") - F.col("b_id")) % 13), "jaccard_cb8": F.when((F.col("a_id") + F.col("b_id")) % 3 > 0, F.col("jaccard"))})
    return rounded(pairs.pair_features(p, "g", "id", "score", "seed", "weight", {"mean_rmsd": "rmsd", "mean_j_cb8": "jaccard_cb8"}, "second"))


@query(with_(MEMB + DIR, "SELECT d.g, d.id, round(sum(jaccard * m.score) / nullif(sum(jaccard), 0), 6) AS weighted_score FROM dir d JOIN memb m ON m.g = d.g AND m.id = d.other GROUP BY d.g, d.id"))
def sim_weighted_mean(spark, sf):
    return rounded(pairs.pair_features(_pairs(spark, sf), "g", "id", "score", "seed", "weight").select("g", "id", "weighted_score"))


DEC = "round(avg(jaccard) FILTER ({c}), 6) AS {n}, count(jaccard) FILTER ({c}) AS n_{n}"


@query(with_(MEMB, "SELECT g, count(*) AS pairs, count(jaccard) AS valid_pairs, round(avg(jaccard), 6) AS mean_j, " + DEC.format(c="weight_a = weight_b AND seed_a <> seed_b", n="across_seeds") + ", " + DEC.format(c="weight_a <> weight_b AND seed_a = seed_b", n="across_weights") + " FROM prs GROUP BY g"))
def pair_decomposition(spark, sf):
    return rounded(pairs.decomposition(_pairs(spark, sf), "g", "seed", "weight"))


@query(with_(MEMB, "SELECT s.g, count(*) AS members, count(*) FILTER (n > 0) AS non_empty, round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS pop_std_score, any_value(coalesce(vp, 0))::BIGINT AS valid_pairs, round(any_value(mj), 6) AS mean_j, round(any_value(lj), 6) AS min_j, round(any_value(dj), 6) AS median_j, CASE WHEN count(*) FILTER (n > 0) < 2 THEN 'insufficient_nonempty_members' ELSE 'ok' END AS status FROM siz s LEFT JOIN (SELECT g, count(jaccard) AS vp, avg(jaccard) AS mj, min(jaccard) AS lj, median(jaccard) AS dj FROM prs GROUP BY g) p ON p.g = s.g GROUP BY s.g"))
def ensemble_summary(spark, sf):
    m = members(spark, sf)
    e = pairs.ensemble_summary(m, _pairs(spark, sf), "g", "contacts", "score")
    return e.select("g", "members", "non_empty", r("mean_score", 4).alias("mean_score"), r("pop_std_score", 4).alias("pop_std_score"), "valid_pairs", r("mean_j").alias("mean_j"), r("min_j").alias("min_j"), r("median_j").alias("median_j"), "status")


@query(with_(MEMB, "SELECT CASE WHEN l = 2 THEN 'both' WHEN l = 1 THEN 'mixed' ELSE 'neither' END AS labels, count(*) AS pairs, round(avg(jaccard), 6) AS mean_j, round(median(jaccard), 6) AS median_j, round(avg(same), 6) AS same_cluster FROM (SELECT jaccard, (x.score >= 250000)::INT + (y.score >= 250000)::INT AS l, (x.id % 3 = y.id % 3)::INT AS same FROM prs p JOIN memb x ON x.g = p.g AND x.id = p.a JOIN memb y ON y.g = p.g AND y.id = p.b) GROUP BY 1"))
def pair_label_groups(spark, sf):
    lab = members(spark, sf).select("g", "id", (F.col("score") >= 250000).alias("y"), (F.col("id") % 3).alias("c"))
    return rounded(pairs.label_groups(_pairs(spark, sf), lab, "g", "id", "y", "c"))


SLOT = ", sl AS (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY weight, seed, id)::INT AS k FROM memb), mt AS (SELECT x.g, x.k AS i, y.k AS j, x.id, d.jaccard FROM sl x JOIN sl y ON x.g = y.g LEFT JOIN dir d ON d.g = x.g AND d.id = x.id AND d.other = y.id), mx AS (SELECT g, i, j, id, CASE WHEN i = j THEN 1.0::DOUBLE ELSE coalesce(jaccard, avg(CASE WHEN i <> j THEN jaccard END) OVER (PARTITION BY g), 0.0::DOUBLE) END AS value, i <> j AND jaccard IS NULL AS imputed FROM mt)"


@query(with_(MEMB + DIR + SLOT, "SELECT g, i, j, id, round(value, 6) AS value, imputed FROM mx"))
def sim_matrix(spark, sf):
    return rounded(pairs.similarity_matrix(members(spark, sf), _pairs(spark, sf), "g", "id", ["weight", "seed", "id"]))


@query(with_(MEMB + DIR + SLOT, "SELECT g, id, i AS slot, array_to_string(list(format('{:.6f}', value) ORDER BY j), ',') AS vector FROM mx WHERE i <> j GROUP BY g, id, i"))
def row_vectors(spark, sf):
    m = pairs.similarity_matrix(members(spark, sf), _pairs(spark, sf), "g", "id", ["weight", "seed", "id"])
    v = pairs.row_vectors(m, "g", "id")
    return v.select("g", "id", "slot", F.array_join(F.transform("vector", lambda x: F.format_string("%.6f", x)), ",").alias("vector"))


# geometry


@query(with_(ATOM, "SELECT DISTINCT g, ra, rb FROM near WHERE d2 < 0.15::DOUBLE * 0.15::DOUBLE"))
def contacts(spark, sf):
    return geometry.contacts(atoms(spark, sf), 0.15)


@query(with_(ATOM, "SELECT DISTINCT g, ra, rb FROM near WHERE role_a = 1 AND role_b = 1 AND d2 < 0.2::DOUBLE * 0.2::DOUBLE"))
def cb_contacts(spark, sf):
    return geometry.representative_contacts(atoms(spark, sf), F.col("role") == 1, 0.2)


@query(with_(ATOM, """, n AS (SELECT g, count(*) FILTER (d2 < 0.08::DOUBLE * 0.08::DOUBLE) AS clashes, count(*) FILTER (d2 < 0.08::DOUBLE * 0.08::DOUBLE AND role_a = 0 AND role_b = 0) AS backbone_clashes FROM near WHERE d2 < 0.15::DOUBLE * 0.15::DOUBLE GROUP BY g),
t AS (SELECT DISTINCT g, 'A' AS side, ra AS res FROM near WHERE d2 < 0.15::DOUBLE * 0.15::DOUBLE UNION SELECT DISTINCT g, 'B', rb FROM near WHERE d2 < 0.15::DOUBLE * 0.15::DOUBLE),
s AS (SELECT g, count(*) AS interface_atoms FROM atom SEMI JOIN t USING (g, side, res) GROUP BY g)
SELECT g, clashes, backbone_clashes, coalesce(interface_atoms, 0)::BIGINT AS interface_atoms, round(CASE WHEN interface_atoms <> 0 THEN clashes * 100.0::DOUBLE / interface_atoms END, 6) AS clash_density FROM n LEFT JOIN s USING (g)""").replace("b.side = 'B')\n,", "b.side = 'B'),"))
def clashes(spark, sf):
    a = atoms(spark, sf).withColumn("bb", F.col("role") == 0)
    return rounded(geometry.clashes(a, "bb", 0.15, 0.08))


@query(with_(ATOM, """, p AS (SELECT DISTINCT g, ra, rb FROM near WHERE d2 < 0.15::DOUBLE * 0.15::DOUBLE), h AS (SELECT g, side, res, bool_or(kind = 2) AS h FROM atom GROUP BY ALL),
c AS (SELECT g, ra, rb, bool_or(q < 0 AND d2 < 0.12::DOUBLE * 0.12::DOUBLE) AS s, bool_or(q > 0 AND d2 < 0.15::DOUBLE * 0.15::DOUBLE) AS l FROM (SELECT *, (CASE kind_a WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) * (CASE kind_b WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS q FROM near WHERE d2 < 0.15::DOUBLE * 0.15::DOUBLE) GROUP BY ALL)
SELECT g, contact_pairs, hydrophobic, salt_bridges, like_charges, round(hydrophobic / contact_pairs, 6) AS hydrophobic_fraction, round(salt_bridges / contact_pairs, 6) AS salt_fraction FROM (
SELECT p.g, count(*) AS contact_pairs, count(*) FILTER (x.h AND y.h) AS hydrophobic, count(*) FILTER (s) AS salt_bridges, count(*) FILTER (l) AS like_charges FROM p JOIN h x ON x.g = p.g AND x.side = 'A' AND x.res = p.ra JOIN h y ON y.g = p.g AND y.side = 'B' AND y.res = p.rb LEFT JOIN c ON c.g = p.g AND c.ra = p.ra AND c.rb = p.rb GROUP BY p.g)""").replace("b.side = 'B')\n,", "b.side = 'B'),"))
def chem_contacts(spark, sf):
    a = atoms(spark, sf).withColumns({"charge": F.expr("CASE kind WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"), "hyd": F.col("kind") == 2})
    return rounded(geometry.chemistry(a, "charge", "hyd", 0.15, 0.12, 0.15))


@query()
def interface_topology(spark, sf):
    area = kernels.surface_areas(atoms(spark, sf), "g", unit=20.0)
    lost = area.select("g", ((F.col("area_a") + F.col("area_b") - F.col("area_both")) / 2).alias("area"))
    return rounded(kernels.interface_topology_of_atoms(atoms(spark, sf), "g", 0.15, lost))


@query(with_(ATOM, ", e AS (SELECT DISTINCT g || '|A|' || ra AS a, g || '|B|' || rb AS b FROM near WHERE d2 < 0.12::DOUBLE * 0.12::DOUBLE), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other)\nSELECT node, min(other) AS comp FROM reach GROUP BY node").replace("WITH atom", "WITH RECURSIVE atom").replace("b.side = 'B')\n,", "b.side = 'B'),"))
def components(spark, sf):
    from ..sources.readers import table_checkpoint

    table_checkpoint(spark)
    c = geometry.contacts(atoms(spark, sf), 0.12)
    node = lambda s, x: F.concat_ws("|", F.col("g").cast("string"), F.lit(s), F.col(x).cast("string"))
    return kernels.connected_components(c.select(node("A", "ra").alias("a"), node("B", "rb").alias("b")))


@query()
def sasa_bsa(spark, sf):
    from ..functions.columns import buried_area

    s = kernels.surface_areas(atoms(spark, sf), "g", unit=20.0)
    half, log = buried_area("area_a", "area_b", "area_both")
    return s.select("g", r("area_a", 3).alias("area_a"), r("area_b", 3).alias("area_b"), r("area_both", 3).alias("area_both"), r(half, 3).alias("buried"), r(log).alias("log_buried"))


@query()
def pose_rmsd(spark, sf):
    """63 components of an embedding as 21 points: 11 are the receptor, 10 the ligand; ten vectors of a label make a group."""
    from ..bindings import table

    e = table(spark, sf, "embeddings").withColumn("g", F.expr("label * 1000 + vec_id div 50"))
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(kernels.pose_rmsd(e.select("g", F.col("vec_id").alias("id"), F.slice(x, 1, 33).alias("a"), F.slice(x, 34, 30).alias("b")), "g", "id", "a", "b"))


@query()
def avg_linkage(spark, sf):
    return rounded(kernels.clusters(members(spark, sf), "g", "id", "contacts", 0.9))


@query(with_(NAMED, f"SELECT id, CASE WHEN may AND s > d THEN s ELSE d END AS truth, CASE WHEN may AND s > d THEN 'swapped' ELSE 'direct' END AS mapping, round(CASE WHEN may THEN greatest(0, s - d) ELSE 0 END, 6) AS gain FROM (SELECT id, (id % 100) / 100.0::DOUBLE AS d, ((id * 7) % 100) / 100.0::DOUBLE AS s, a = b AND NOT {UNKNOWN.format(x='a')} AND NOT {UNKNOWN.format(x='b')} AS may FROM acc)"))
def symmetry_best(spark, sf):
    from ..functions.columns import accession, same_known

    d = _named(spark, sf).withColumns({"d": (F.col("id") % 100) / 100, "s": ((F.col("id") * 7) % 100) / 100})
    return rounded(geometry.best_mapping(d, "d", "s", same_known(accession("name", 0), accession("name", 1))).select("id", "truth", "mapping", "gain"))


@query(with_(NAMED, f"SELECT id, CASE WHEN u AND m = 'swapped' THEN d ELSE c END AS corrected, CASE WHEN u AND m = 'swapped' THEN 'direct' ELSE m END AS corrected_mapping, (CASE WHEN u AND m = 'swapped' THEN d ELSE c END) <> c AS changed, ((CASE WHEN u AND m = 'swapped' THEN d ELSE c END) >= 0.23) <> (c >= 0.23) AS crossed FROM (SELECT id, (id % 100) / 100.0::DOUBLE AS d, greatest((id % 100) / 100.0::DOUBLE, ((id * 7) % 100) / 100.0::DOUBLE) AS c, CASE WHEN id % 2 = 0 THEN 'swapped' ELSE 'direct' END AS m, {UNKNOWN.format(x='a')} OR {UNKNOWN.format(x='b')} AS u FROM acc)"))
def label_correction(spark, sf):
    from ..functions.columns import accession, is_null_token

    d = _named(spark, sf).withColumns({"d": (F.col("id") % 100) / 100, "m": F.when(F.col("id") % 2 == 0, "swapped").otherwise("direct")})
    d = d.withColumn("c", F.greatest("d", ((F.col("id") * 7) % 100) / 100))
    u = is_null_token(accession("name", 0)) | is_null_token(accession("name", 1))
    return geometry.corrected_labels(d, "d", "c", "m", u).select("id", "corrected", "corrected_mapping", "changed", "crossed")


@query(with_(MEMB, "SELECT g, count(*) FILTER (seed_a = 0 AND seed_b = 0) AS pairs, count(jaccard) FILTER (seed_a = 0 AND seed_b = 0) AS valid_pairs, round(avg(jaccard) FILTER (seed_a = 0 AND seed_b = 0), 6) AS mean_j FROM prs GROUP BY g"))
def seed_subset(spark, sf):
    from ..operators import cohort

    return rounded(cohort.one_seed(_pairs(spark, sf), "g", "seed"))
