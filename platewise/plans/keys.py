"""Key parsing, projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.functions.expr import log5_conc, log5_conc_inverse, rnd
from platewise.operators import keys as K
from platewise.plans.registry import OBJ, query
from platewise.plans.sources import WELL_SQL, well_name

BARCODE_SQL = """bc AS (SELECT s_suppkey, 'D' || lpad(s_nationkey::VARCHAR, 3, '0') || 'T01P' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0')
  || 'L' || lpad((s_suppkey % 10)::VARCHAR, 2, '0') AS barcode FROM supplier)"""


def _barcodes(t):
    s = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", F.concat(
        F.lit("D"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lit("T01P"),
        F.lpad((s % 1000).cast("string"), 3, "0"), F.lit("L"), F.lpad((s % 10).cast("string"), 2, "0")).alias("barcode"))


@query("parse_barcode", f"""WITH {BARCODE_SQL}
SELECT s_suppkey, barcode || '_B_07' AS barcode, barcode[1:7] AS line, barcode[1:14] AS plate, barcode[12:14] AS layout, 'B07' AS well FROM bc""")
def parse_barcode(t):
    b = _barcodes(t).withColumn("barcode", F.concat("barcode", F.lit("_B_07")))
    return K.parse_barcode(b, "barcode", well="well")


@query("parse_well", f"""WITH w AS (SELECT DISTINCT l_suppkey AS plate, l_partkey % 384 AS well FROM lineitem), n AS (SELECT plate, {WELL_SQL} AS name FROM w)
SELECT plate, name, ascii(name) - 64 AS row, substr(name, 2, 2)::INT AS col FROM n""")
def parse_well(t):
    names = t.wells.select("plate", "well").distinct().select("plate", well_name().alias("name"))
    return K.parse_well(names, "name")


@query("parse_screen", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'HCO-JB' AS tag1, 'M2' AS tag2, 'P' || o_custkey AS plate FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 100 YEAR, '%Y-%m-%d'), 'HCO-JB', 'M2', 'P' || o_custkey FROM orders
WHERE o_orderdate < TIMESTAMP '2000-01-01'""")
def parse_screen(t):
    s = t.orders.select("o_orderkey", F.concat_ws("_", F.date_format("o_orderdate", "yyMMdd"), F.lit("HCO"), F.lit("JB"), F.lit("M2"), F.concat(F.lit("P"), "o_custkey")).alias("screen"))
    return K.parse_screen(s, "screen").select("o_orderkey", F.col("date").cast("string").alias("date"), "tag1", "tag2", "plate")


@query("species_of", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'mouse' ELSE 'human' END AS species FROM supplier""")
def species_of(t):
    b = t.supplier.select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 3 == 0, "M").otherwise("D"), "s_suppkey").alias("plate"))
    return b.select("s_suppkey", K.species_of("plate").alias("species"))


@query("plate_filters", f"WITH {BARCODE_SQL} SELECT DISTINCT barcode[1:7] AS line, barcode AS plate FROM bc WHERE barcode[1:7] = 'D003T01'")
def plate_filters(t):
    return K.plate_filters(_barcodes(t), "barcode", species="human", line="D003T01")


@query("layout_join", f"""WITH {OBJ}, layout AS (SELECT p_type AS target, p_partkey AS part, p_brand AS treatment, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 50.0 END AS dose FROM part WHERE p_size > 10)
SELECT uuid, part, treatment, dose FROM obj LEFT JOIN layout USING (target, part)""")
def layout_join(t):
    layout = t.part.where("p_size > 10").select(
        F.col("p_type").alias("target"), F.col("p_partkey").alias("part"), F.col("p_brand").alias("treatment"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") / F.lit(50.0)).alias("dose"))
    return K.layout_join(t.objects.select("uuid", "target", "part"), layout, ["target", "part"]).select("uuid", "part", "treatment", "dose")


@query("target_annotation", """
WITH d AS (SELECT p_brand AS drug, min((p_type, p_size)) AS f FROM part WHERE p_size > 5 GROUP BY 1)
SELECT l_suppkey AS plate, l_partkey AS part, d.drug, f[1] AS target, f[2] AS pathway, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN d ON d.drug = p_brand GROUP BY ALL""")
def target_annotation(t):
    lay = t.part.where("p_size > 5").select(F.col("p_brand").alias("drug"), F.col("p_type").alias("target"), F.col("p_size").alias("pathway"))
    per = t.objects.groupBy("plate", "part", "drug").agg(F.count(F.lit(1)).alias("n"))
    return K.target_annotation(per, [lay.where("pathway <= 25"), lay.where("pathway > 25")], "drug", ["target", "pathway"])


@query("drug_conc_label", f"""WITH {OBJ}, x AS (SELECT uuid, CASE WHEN ctrl THEN 'DMSO' ELSE drug END AS drug, CASE WHEN conc > 0 THEN (conc * 100)::INT END AS conc FROM obj)
SELECT uuid, CASE WHEN drug = 'DMSO' OR conc IS NULL THEN drug ELSE drug || '__' || conc END AS label FROM x""")
def drug_conc_label(t):
    x = t.objects.select("uuid", F.when(F.col("ctrl"), "DMSO").otherwise(F.col("drug")).alias("drug"),
                         F.when(F.col("conc") > 0, F.round(F.col("conc") * 100).cast("int")).alias("conc"))
    return x.select("uuid", K.drug_conc_label("drug", "conc").alias("label"))


@query("safe_name", "SELECT p_partkey, replace(replace(p_name || ' / ' || p_type, '/', '|'), ' ', '_') AS name FROM part")
def safe_name(t):
    return t.part.select("p_partkey", K.safe_name(F.concat_ws(" / ", "p_name", "p_type")).alias("name"))


@query("rename_clean", "SELECT s_suppkey AS supp_key, s_name AS supplier_name, s_acctbal AS account_balance_usd FROM supplier")
def rename_clean(t):
    messy = t.supplier.select(F.col("s_suppkey").alias("SuppKey"), F.col("s_name").alias("Supplier Name"), F.col("s_acctbal").alias("account.balance (USD)"))
    return K.rename_clean(messy)


FEATURE_NAMES_SQL = """f AS (SELECT p_partkey, 'x.' || ['0', 'a', 'b', 'c', 'ab', 'abc', 'B', 'aB', 'Bc'][p_size % 9 + 1] || '.' || ['s', 'b', 'h', 'm', 'q'][p_partkey % 5 + 1] || '.' || p_size AS name FROM part)"""


def _feature_names(t):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i)
    return t.part.select("p_partkey", F.concat_ws(
        ".", F.lit("x"), pick(["0", "a", "b", "c", "ab", "abc", "B", "aB", "Bc"], F.col("p_size") % 9 + 1),
        pick(["s", "b", "h", "m", "q"], (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_size").cast("string")).alias("name"))


@query("feature_class_tag", f"""WITH {FEATURE_NAMES_SQL}
SELECT p_partkey, name, CASE string_split(name, '.')[3] WHEN 's' THEN 'shape' WHEN 'b' THEN 'basic' WHEN 'h' THEN 'haralick' WHEN 'm' THEN 'moment' END AS class,
string_split(name, '.')[2] AS channel FROM f""")
def feature_class_tag(t):
    return K.feature_class_tag(_feature_names(t))


@query("channel_feature_filter", f"""WITH {FEATURE_NAMES_SQL}
SELECT p_partkey, name FROM f WHERE string_split(name, '.')[2] IN ('a', 'b', 'ab', 'B', 'aB')""")
def channel_feature_filter(t):
    tagged = K.feature_class_tag(_feature_names(t))
    return K.channel_feature_filter(tagged, "channel", ["a", "b"]).select("p_partkey", "name")


@query("uuid_key", "SELECT l_suppkey || '_' || l_partkey || '_' || l_linenumber || '_' || l_orderkey AS uuid FROM lineitem")
def uuid_key(t):
    return t.lineitem.select(K.uuid_key("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey").alias("uuid"))


@query("log_size", "SELECT p_partkey, round(ln(p_retailprice), 6) AS ln_size FROM part")
def log_size(t):
    return t.part.select("p_partkey", rnd(K.log_size("p_retailprice")).alias("ln_size"))


@query("relabel_conditional", """
SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN 'L007b' ELSE 'L' || s_nationkey END AS line,
CASE WHEN s_nationkey = 7 THEN replace(s_name, 'Supplier#', 'Plate-') ELSE s_name END AS plate FROM supplier""")
def relabel_conditional(t):
    s = t.supplier.select("s_suppkey", "s_nationkey", F.concat(F.lit("L"), "s_nationkey").alias("line"), F.col("s_name").alias("plate"))
    return K.relabel_conditional(s, "line", F.col("s_nationkey") == 7, "L007b", "plate", "Supplier#", "Plate-").drop("s_nationkey")


@query("flag_wells_na", """
WITH w AS (SELECT l_suppkey AS plate, l_partkey % 384 AS well, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT plate, well, CASE WHEN (well // 24) % 2 = 0 AND well % 24 < 13 THEN NULL ELSE n END AS pcount FROM w""")
def flag_wells_na(t):
    w = t.wells.groupBy("plate", "well").agg(F.count(F.lit(1)).alias("pcount"))
    return K.flag_wells_na(w, "pcount", (F.floor(F.col("well") / 24) % 2 == 0) & (F.col("well") % 24 < 13))


@query("exclude_keys", f"WITH {OBJ} SELECT line, count(*) AS n FROM obj WHERE line NOT IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING avg(s_acctbal) < 5000) GROUP BY 1")
def exclude_keys(t):
    bad = t.supplier.groupBy(F.col("s_nationkey").alias("line")).agg(F.avg("s_acctbal").alias("m")).where("m < 5000")
    return K.exclude_keys(t.objects, bad, ["line"]).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("viability_bins", """
WITH v AS (SELECT event_id, value / 100 AS v FROM events)
SELECT CASE WHEN v <= 0 THEN '<=0' WHEN v <= .2 THEN '(0,0.2]' WHEN v <= .4 THEN '(0.2,0.4]' WHEN v <= .6 THEN '(0.4,0.6]'
 WHEN v <= .8 THEN '(0.6,0.8]' WHEN v <= 1 THEN '(0.8,1]' ELSE '>1' END AS bin, count(*) AS n FROM v GROUP BY 1""")
def viability_bins(t):
    v = t.events.select((F.col("value") / 100).alias("v"))
    return v.groupBy(K.viability_bins("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("string_group_tag", """
SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|widget') THEN 'solid' WHEN regexp_matches(p_name, '^blue') THEN 'blue' END AS tag FROM part""")
def string_group_tag(t):
    return t.part.select("p_partkey", K.string_group_tag("p_name", {"solid": "ring|widget", "blue": "^blue"}).alias("tag"))


@query("pseudo_conc", f"WITH {OBJ} SELECT uuid, CASE WHEN ctrl THEN 0.00032 ELSE conc END AS conc FROM obj")
def pseudo_conc(t):
    x = t.objects.select("uuid", "conc", F.when(F.col("ctrl"), "DMSO").otherwise("drug").alias("d"))
    return x.select("uuid", K.pseudo_conc("d", "conc", 0.00032).alias("conc"))


@query("log5_conc", """
SELECT p_partkey, round(ln(p_size) / ln(5) + 5, 6) AS level, round(pow(5, ln(p_size) / ln(5)), 6) AS back FROM part""")
def log5_conc_q(t):
    x = t.part.select("p_partkey", log5_conc(F.col("p_size")).alias("level"))
    return x.select("p_partkey", rnd("level").alias("level"), rnd(log5_conc_inverse("level")).alias("back"))


@query("reps_expand", "SELECT s_suppkey, rep FROM supplier, (VALUES ('r1'), ('r2')) r(rep)")
def reps_expand(t):
    return K.reps_expand(t.supplier.select("s_suppkey"), ["r1", "r2"])


@query("sample_name_parse", r"""
SELECT p_partkey, regexp_extract(p_brand || '_' || p_name, '^Brand#(\d+)_(\w+) (\w+)', 1) AS line,
regexp_extract(p_brand || '_' || p_name, '^Brand#(\d+)_(\w+) (\w+)', 2) AS treatment,
regexp_extract(p_brand || '_' || p_name, '^Brand#(\d+)_(\w+) (\w+)', 3) AS rep FROM part""")
def sample_name_parse(t):
    s = t.part.select("p_partkey", F.concat_ws("_", "p_brand", "p_name").alias("sample"))
    return K.sample_name_parse(s, "sample", r"^Brand#(\d+)_(\w+) (\w+)", ["line", "treatment", "rep"]).drop("sample")


@query("separate_unite", """
SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS word,
split_part(o_orderpriority, '-', 1) || '__' || o_orderstatus AS joined, substr(o_orderpriority, 1, 3) AS head, substr(o_orderpriority, 4) AS tail FROM orders""")
def separate_unite(t):
    o = K.separate(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", ["level", "word"], "-")
    o = K.separate(K.unite(o, "joined", ["level", "o_orderstatus"], "__"), "o_orderpriority", ["head", "tail"], 3)
    return o.drop("o_orderpriority", "o_orderstatus")


@query("drop_nulls", """
SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def drop_nulls(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return K.drop_nulls(d, ["quality"])


@query("fill_nulls", "SELECT doc_id, n_chars, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def fill_nulls(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return K.fill_nulls(d, ["quality"], 0)


@query("phenotype_tag", """
SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 3, 5) THEN 'solid' WHEN s_nationkey IN (2, 4) THEN 'cystic' ELSE 'other' END AS phenotype FROM supplier""")
def phenotype_tag(t):
    return t.supplier.select("s_suppkey", K.phenotype_tag("s_nationkey", {"solid": [1, 3, 5], "cystic": [2, 4]}).alias("phenotype"))


@query("exact2_filter", f"""WITH {OBJ}
SELECT uuid, plate, well FROM obj WHERE (plate, well) IN (SELECT (plate, well) FROM obj GROUP BY plate, well HAVING count(*) = 2)""")
def exact2_filter(t):
    return K.exact2_filter(t.objects.select("uuid", "plate", "well"), ["plate", "well"])


@query("token_split_explode", r"""
WITH x AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_type || ', ' || replace(p_name, ' ', '/')), ',\s*|/')) AS token FROM part)
SELECT token, count(*) AS n, count_if(token = 'ring')::BIGINT AS rings FROM x WHERE token <> '' GROUP BY 1""")
def token_split_explode(t):
    x = t.part.select(F.concat(F.col("p_type"), F.lit(", "), F.regexp_replace("p_name", " ", "/")).alias("targets"))
    return K.token_split_explode(x, "targets").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(K.has_word("token", "ring")).alias("rings"))
