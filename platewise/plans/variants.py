"""Variant and annotation queries; variant lines are made from the part and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import variants as V
from platewise.plans.registry import query

# one variant line per part: caller fields, and two annotated transcripts (none for every 11th part)
LINES = """raw AS (SELECT p_partkey AS k, 'S' || (p_size % 10) AS sample, 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 10 AS pos,
 CASE WHEN p_partkey % 9 = 0 THEN '.' ELSE (p_partkey % 100)::VARCHAR END AS fs, p_partkey % 7 AS ecnt,
 CASE WHEN p_partkey % 13 = 0 THEN '.' ELSE '0/1' END AS gt, (p_partkey % 50) || ',' || (p_partkey % 31) AS ad, CASE WHEN p_partkey % 5 = 0 THEN '0.05' ELSE '0.' || (p_partkey % 8 + 1) END AS af,
 ['missense_variant', 'splice_donor_variant,intron_variant', 'inframe_deletion', 'stop_gained'][p_partkey // 10 % 4 + 1] AS cons,
 ['HIGH', 'MODERATE', 'LOW'][p_partkey % 3 + 1] AS impact, upper(string_split(p_name, ' ')[2]) AS symbol,
 CASE WHEN p_partkey % 2 = 0 THEN 'COSM' || p_partkey ELSE 'rs' || p_partkey END AS known,
 CASE WHEN p_partkey % 6 = 0 THEN 'tolerated(0.3)' ELSE 'deleterious(0)' END AS sift, CASE WHEN p_partkey % 4 = 0 THEN 'benign(0)' ELSE '-' END AS pp,
 CASE WHEN p_partkey % 7 = 0 THEN '0.02' ELSE '-' END AS gn, CASE WHEN p_partkey % 10 < 8 THEN 'YES' ELSE '-' END AS can FROM part)"""


def lines(t):
    k = F.col("p_partkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    s = lambda c: c.cast("string")
    cons = pick(["missense_variant", "splice_donor_variant&intron_variant", "inframe_deletion", "stop_gained"], F.floor(k / 10) % 4)
    impact = pick(["HIGH", "MODERATE", "LOW"], k % 3)
    symbol = F.upper(F.split("p_name", " ")[1])
    known = F.concat(F.when(k % 2 == 0, "COSM").otherwise("rs"), s(k))
    sift = F.when(k % 6 == 0, "tolerated(0.3)").otherwise("deleterious(0)")
    pp = F.when(k % 4 == 0, "benign(0)").otherwise("")
    gn = F.when(k % 7 == 0, "0.02").otherwise("")
    can = F.when(k % 10 < 8, "YES").otherwise("")
    one = lambda tag: F.concat_ws("|", F.concat(F.lit(tag), s(k)), F.lit("Transcript"), cons, F.lit("12"), F.lit("A/T"), F.lit(""), known, impact, symbol, F.lit("protein_coding"), sift, pp, F.lit("3/9"), gn, F.lit(""), F.lit(""), can)
    head = F.concat(F.lit("ECNT="), s(k % 7), F.lit(";FS="), F.when(k % 9 == 0, ".").otherwise(s(k % 100)), F.lit(";"))
    info = F.when(k % 11 == 0, head).otherwise(F.concat(head, F.lit("CSQ="), one("ENST0"), F.lit(","), one("ENST1")))
    data = F.concat_ws(":", F.when(k % 13 == 0, ".").otherwise("0/1"), F.concat_ws(",", s(k % 50), s(k % 31)), F.when(k % 5 == 0, "0.05").otherwise(F.concat(F.lit("0."), s(k % 8 + 1))))
    text = F.concat_ws("\t", F.concat(F.lit("chr"), s(k % 22 + 1)), s(k * 10), F.lit("."), F.lit("A"), F.lit("T"), F.lit("50"), F.lit("PASS"), info, F.lit("GT:AD:AF"), data)
    raw = t.part.select(F.concat(F.lit("S"), F.col("p_size") % 10).alias("sample"), F.split(text, "\t").alias("fields"))
    return V.vcf_columns(raw)


def annotated(t):
    v = V.vep_explode(V.vcf_info_fields(V.vcf_format_fields(lines(t)), ["ECNT", "FS"]), [*V.ANNOTATION_FIELDS, "CANONICAL"])
    return v


ANNO = LINES + """, anno AS (SELECT raw.*, CASE WHEN k % 11 = 0 THEN '-' ELSE tag || k END AS feature FROM raw JOIN (VALUES ('ENST0'), ('ENST1')) x(tag) ON k % 11 <> 0 OR tag = 'ENST0')"""
KEEP = """flt AS (SELECT * FROM anno WHERE k % 11 <> 0 AND impact IN ('HIGH', 'MODERATE') AND known LIKE '%COSM%' AND NOT (pp LIKE 'benign%' AND sift LIKE 'tolerated%') AND af::DOUBLE > .1 AND TRY_CAST(fs AS DOUBLE) < 60
 AND coalesce(TRY_CAST(gn AS DOUBLE) < 0.001, true) AND can = 'YES' AND split_part(ad, ',', 2)::DOUBLE > 9)"""
NORM = """nrm AS (SELECT sample, symbol, chrom, pos, CASE WHEN split_part(cons, ',', 1) LIKE 'splice%' THEN 'splice_variant' ELSE split_part(cons, ',', 1) END AS consequence FROM flt WHERE split_part(cons, ',', 1) NOT LIKE 'inframe%')"""


@query("vcf_format_fields", f"WITH {LINES} SELECT sample, pos::VARCHAR AS pos, CASE WHEN gt = '.' THEN '-' ELSE gt END AS gt, ad, af FROM raw")
def vcf_format_fields(t):
    return V.vcf_format_fields(lines(t)).select("sample", F.col("POS").alias("pos"), F.col("GT").alias("gt"), F.col("AD").alias("ad"), F.col("AF").alias("af"))


@query("vcf_info_fields", f"WITH {LINES} SELECT sample, pos::VARCHAR AS pos, CASE WHEN fs = '.' THEN '-' ELSE fs END AS fs, ecnt::VARCHAR AS ecnt, '-' AS tlod FROM raw")
def vcf_info_fields(t):
    return V.vcf_info_fields(lines(t)).select("sample", F.col("POS").alias("pos"), F.col("FS").alias("fs"), F.col("ECNT").alias("ecnt"), F.col("TLOD").alias("tlod"))


@query("vep_explode", f"WITH {ANNO} SELECT sample, pos::VARCHAR AS pos, feature, CASE WHEN k % 11 = 0 THEN '-' ELSE cons END AS consequence, CASE WHEN k % 11 = 0 THEN '-' ELSE symbol END AS symbol, CASE WHEN k % 11 = 0 THEN '-' ELSE gn END AS gnomad, '-' AS pubmed FROM anno")
def vep_explode(t):
    v = annotated(t)
    return v.select("sample", F.col("POS").alias("pos"), F.col("Feature").alias("feature"), F.col("Consequence").alias("consequence"), F.col("SYMBOL").alias("symbol"), F.col("gnomAD_AF").alias("gnomad"), F.col("PUBMED").alias("pubmed"))


@query("variant_filter", f"WITH {ANNO}, {KEEP} SELECT sample, pos::VARCHAR AS pos, feature FROM flt")
def variant_filter(t):
    return V.variant_filter(annotated(t)).select("sample", F.col("POS").alias("pos"), F.col("Feature").alias("feature"))


def _normal(t):
    return V.consequence_normalise(V.variant_filter(annotated(t)))


@query("consequence_normalise", f"WITH {ANNO}, {KEEP}, {NORM} SELECT consequence, count(*) AS n FROM nrm GROUP BY 1")
def consequence_normalise(t):
    return _normal(t).groupBy(F.col("Consequence").alias("consequence")).agg(F.count(F.lit(1)).alias("n"))


GENES = ["ANVIL", "BOLT", "GEAR", "GIZMO", "PLATE", "RING", "ROD", "WIDGET"]


@query("variant_matrix", f"""WITH {ANNO}, {KEEP}, {NORM}, d AS (SELECT sample, symbol, string_agg(consequence, ';' ORDER BY consequence) AS c FROM (SELECT DISTINCT sample, symbol, consequence FROM nrm) GROUP BY ALL)
SELECT sample, {', '.join(f"max(c) FILTER (symbol = '{g}') AS {g}" for g in GENES)} FROM d GROUP BY sample""")
def variant_matrix(t):
    return V.variant_matrix(_normal(t), "sample", "SYMBOL", "Consequence", GENES)


@query("variant_final_table", f"WITH {ANNO}, {KEEP}, {NORM} SELECT DISTINCT sample, chrom, pos::VARCHAR AS pos, symbol, consequence FROM nrm")
def variant_final_table(t):
    f = V.variant_final_table(_normal(t), ["sample", "CHROM", "POS", "SYMBOL", "Consequence"])
    return f.toDF("sample", "chrom", "pos", "symbol", "consequence")


@query("gene_alias_patch", "SELECT p_partkey, CASE upper(string_split(p_name, ' ')[2]) WHEN 'RING' THEN 'RING1' ELSE upper(string_split(p_name, ' ')[2]) END AS symbol FROM part")
def gene_alias_patch(t):
    return V.gene_alias_patch(t.part.select("p_partkey", F.upper(F.split("p_name", " ")[1]).alias("symbol")), "symbol", {"RING": "RING1"})


@query("manifest_dedupe", """WITH m AS (SELECT p_name AS name, 'chr' || (p_size % 22) || ':' || p_size * 100 || '-' || (p_size * 100 + 50) AS interval, p_size FROM part)
SELECT interval, min(name) AS name, split_part(interval, ':', 1) AS chrom, (any_value(p_size) * 100)::BIGINT AS start, (any_value(p_size) * 100 + 50)::BIGINT AS stop FROM m GROUP BY interval""")
def manifest_dedupe(t):
    s = F.col("p_size")
    m = t.part.select(F.col("p_name").alias("name"), F.concat(F.lit("chr"), s % 22, F.lit(":"), s * 100, F.lit("-"), s * 100 + 50).alias("interval"))
    return V.manifest_dedupe(m, "name", "interval")


@query("probe_gene_map", """WITH m AS (SELECT DISTINCT p_size AS probe, p_partkey AS entrez, p_name AS symbol FROM part WHERE p_size % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY symbol, entrez) AS r FROM m)
SELECT p_partkey, p_size AS probe, entrez, symbol FROM part LEFT JOIN r ON probe = p_size AND r = 1""")
def probe_gene_map(t):
    m = t.part.where("p_size % 5 <> 0").select(F.col("p_size").alias("probe"), F.col("p_partkey").alias("entrez"), F.col("p_name").alias("symbol"))
    return V.probe_gene_map(t.part.select("p_partkey", F.col("p_size").alias("probe")), m, "probe", ["symbol", "entrez"])


@query("signature_table", """SELECT 'p_name' AS signature, p_name AS symbol FROM part UNION ALL SELECT 'p_type', p_type FROM part WHERE p_size > 10""")
def signature_table(t):
    sheet = t.part.select(F.concat("p_name", F.lit("*")).alias("p_name"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"))
    return V.signature_table(sheet, ["p_name", "p_type"])


@query("missing_annotation_report", "SELECT quality IS NULL AS missing, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def missing_annotation_report(t):
    return V.missing_annotation_report(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality")
