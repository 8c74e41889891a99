"""Annotated variant text, filters and annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import nsjoin
from platewise.operators.sampling import first_per_group

# Caller fields and annotation fields that are kept, in file order
CALL_FIELDS = ["BaseQRankSum", "ECNT", "FS", "HCNT", "MAX_ED", "MIN_ED", "TLOD", "PON", "GT", "AD", "AF"]
ANNOTATION_FIELDS = [
    "Feature", "Feature_type", "Consequence", "Protein_position", "Amino_acids", "Codons", "Existing_variation", "IMPACT",
    "SYMBOL", "BIOTYPE", "SIFT", "PolyPhen", "EXON", "gnomAD_AF", "CLIN_SIG", "PUBMED",
]
LINE_FIELDS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER"]
MISSING = "-"


def vcf_columns(lines: DataFrame, fields: str = "fields") -> DataFrame:
    """Name the tab fields of variant lines."""
    named = [F.get(fields, F.lit(i)).alias(n) for i, n in enumerate([*LINE_FIELDS, "INFO", "FORMAT", "DATA"])]
    return lines.select(*[c for c in lines.columns if c != fields], *named)


def _known(value: Column) -> Column:
    """'.' and absent become '-'."""
    v = F.trim(value)
    return F.when(v.isNull() | (v == "."), F.lit(MISSING)).otherwise(v)


def _last(pairs: Column, key: str) -> Column:
    """Value of the last pair with a key; a key may repeat within a line."""
    return F.get(F.reverse(F.filter(pairs, lambda x: x["k"] == key)), F.lit(0))["v"]


def vcf_format_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Values of FORMAT paired with DATA, one column per kept field."""
    pairs = F.zip_with(F.split("FORMAT", ":"), F.split("DATA", ":"), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return df.select("*", *[_known(_last(pairs, f)).alias(f) for f in (fields or ["GT", "AD", "AF"])])


def vcf_info_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """k=v pairs of INFO before the annotation, one column per kept field."""
    head = F.regexp_replace(F.substring_index("INFO", "CSQ=", 1), ";$", "")
    pairs = F.filter(F.split(head, ";"), lambda x: x.contains("="))
    pairs = F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).alias("v")))
    return df.select("*", *[_known(_last(pairs, f)).alias(f) for f in (fields or CALL_FIELDS[:8])])


def vep_explode(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per annotated transcript; empty fields '-', '&' becomes ','.

    Lines without an annotation keep one row of '-'.
    """
    names = fields or ANNOTATION_FIELDS
    csq = F.when(F.col("INFO").contains("CSQ=ENST"), F.split_part("INFO", F.lit("CSQ="), F.lit(2)))
    df = df.withColumn("_t", F.explode(F.coalesce(F.split(csq, ","), F.array(F.lit(""))))).withColumn("_t", F.split("_t", r"\|"))

    def part(i: int) -> Column:
        v = F.get("_t", F.lit(i))
        return F.when(v.isNull() | (v == ""), F.lit(MISSING)).otherwise(F.regexp_replace(v, "&", ","))

    return df.select(*[c for c in df.columns if c != "_t"], *[part(i).alias(n) for i, n in enumerate(names)])


def number(c: str) -> Column:
    return F.col(c).try_cast("double")


def variant_filter(df: DataFrame, strict: bool = True) -> DataFrame:
    """Reported impact, known mutation, not (benign and tolerated), AF > .1, FS < 60;
    strict adds population frequency, canonical transcript and more than 9 alternative reads."""
    alt = F.split_part("AD", F.lit(","), F.lit(2)).try_cast("double")
    benign = F.col("PolyPhen").rlike("^benign") & F.col("SIFT").rlike("^tolerated")
    keep = (
        F.col("IMPACT").isin("HIGH", "MODERATE") & F.col("Existing_variation").contains("COSM") & ~benign
        & (number("AF") > 0.1) & (number("FS") < 60)
    )
    if strict:
        rare = F.coalesce(number("gnomAD_AF") < 0.001, F.lit(True))
        keep = keep & rare & (F.col("CANONICAL") == "YES") & (alt > 9)
    return df.where(keep)


def consequence_normalise(df: DataFrame, c: str = "Consequence") -> DataFrame:
    """First consequence only; in-frame ones leave, splice ones are merged."""
    first = df.withColumn(c, F.get(F.split(c, ","), F.lit(0))).where(~F.col(c).startswith("inframe"))
    return first.withColumn(c, F.when(F.col(c).startswith("splice"), F.lit("splice_variant")).otherwise(F.col(c)))


def variant_matrix(df: DataFrame, sample: str, gene: str, consequence: str, genes: list | None = None) -> DataFrame:
    """sample × gene table of the distinct consequences pasted by ';'."""
    cells = df.select(sample, gene, consequence).distinct().groupBy(sample, gene).agg(F.array_join(F.sort_array(F.collect_list(consequence)), ";").alias("_c"))
    g = cells.groupBy(sample)
    return (g.pivot(gene, genes) if genes else g.pivot(gene)).agg(F.first("_c"))


def variant_final_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def gene_alias_patch(df: DataFrame, gene: str, aliases: dict[str, str]) -> DataFrame:
    c = F.col(gene)
    for old, new in aliases.items():
        c = F.regexp_replace(c, f"^{old}$", new)
    return df.withColumn(gene, c)


def manifest_dedupe(df: DataFrame, name: str, interval: str) -> DataFrame:
    """Unique intervals 'chr:start-stop' with their parts; the first name in order is kept."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    one = df.groupBy(interval).agg(F.min(name).alias(name))
    return one.withColumn("chrom", F.regexp_extract(interval, pattern, 1)).withColumn("start", F.regexp_extract(interval, pattern, 2).try_cast("long")).withColumn("stop", F.regexp_extract(interval, pattern, 3).try_cast("long"))


def probe_gene_map(probes: DataFrame, mapping: DataFrame, probe: str, order: list[str]) -> DataFrame:
    """One annotation per probe, the first by order; probes without one keep nulls."""
    best = first_per_group(mapping.dropna(subset=[probe]).distinct(), [probe], [F.col(c) for c in order])
    return nsjoin(probes, best, [probe], "left")


def signature_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide sheet (a column per signature) to (signature, symbol) without stars."""
    long = df.select(*columns).unpivot([], columns, "signature", "symbol")
    return long.withColumn("symbol", F.regexp_replace("symbol", r"\*", "")).dropna().where("symbol <> ''")


def missing_annotation_report(df: DataFrame, symbol: str) -> DataFrame:
    return df.groupBy(F.col(symbol).isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))
