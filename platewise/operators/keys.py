"""Key parsing, labels, tags and row exclusion. Pure column expressions and joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.expr import col, nsjoin

CONTROL = "DMSO"

# Feature classes by the class letter of x.<channel>.<class>.<stat>
FEATURE_CLASSES = {"s": "shape", "b": "basic", "h": "haralick", "m": "moment"}


def parse_barcode(df: DataFrame, barcode: str, well: str | None = None) -> DataFrame:
    """line = first 7, plate = first 14, layout = last 3 of the plate barcode;
    a ``X_nn`` tail gives the well name."""
    c = F.col(barcode)
    out = df.withColumn("line", F.substring(c, 1, 7)).withColumn("plate", F.substring(c, 1, 14)).withColumn("layout", F.substring(c, 12, 3))
    if well:
        out = out.withColumn(well, F.concat(F.substring(c, 16, 1), F.substring(c, 18, 2)))
    return out


def parse_well(df: DataFrame, well: str) -> DataFrame:
    """'B07' -> row 2, col 7; anything else gives nulls."""
    ok = F.col(well).rlike(r"^[A-P]\d{2}$")
    return df.withColumn("row", F.when(ok, F.ascii(well) - 64)).withColumn("col", F.when(ok, F.substring(well, 2, 2).cast("int")))


def parse_screen(df: DataFrame, screen: str) -> DataFrame:
    """date_operator_machine_plate; dates are yymmdd of this century."""
    parts = F.split(F.regexp_replace(screen, "HCO_", "HCO-"), "_")
    return (
        df.withColumn("date", F.try_to_date(F.concat(F.lit("20"), F.get(parts, F.lit(0))), "yyyyMMdd"))
        .withColumn("tag1", F.get(parts, F.lit(1))).withColumn("tag2", F.get(parts, F.lit(2))).withColumn("plate", F.get(parts, F.lit(3)))
    )


def species_of(plate: str | Column) -> Column:
    first = F.substring(col(plate), 1, 1)
    return F.when(first == "D", "human").when(first == "M", "mouse").otherwise(
        F.raise_error(F.concat(F.lit("unknown species of plate "), col(plate))))


def plate_filters(plates: DataFrame, plate: str, species: str | None = None, line: str | None = None) -> DataFrame:
    """Distinct (line, plate), in order, of one species and/or line."""
    out = plates.select(F.substring(plate, 1, 7).alias("line"), F.col(plate).alias("plate")).distinct()
    if species:
        out = out.where(species_of("plate") == species)
    if line:
        out = out.where(F.col("line") == line)
    return out.orderBy("line", "plate")


def layout_join(wells: DataFrame, layout: DataFrame, keys: list[str]) -> DataFrame:
    """Attach drug and concentration by (layout, well); wells without an entry keep nulls."""
    return nsjoin(wells, layout, keys, "left")


def target_annotation(rows: DataFrame, layouts: list[DataFrame], drug: str, fields: list[str]) -> DataFrame:
    """Union the layouts' (drug, fields), drop incomplete and repeated entries, left join.

    One entry per drug: the smallest in field order, as several layouts may disagree.
    """
    dim = layouts[0].select(drug, *fields)
    for other in layouts[1:]:
        dim = dim.unionByName(other.select(drug, *fields))
    dim = dim.dropna().groupBy(drug).agg(F.min(F.struct(*fields)).alias("_f")).select(drug, "_f.*")
    return nsjoin(rows, dim, [drug], "left")


def drug_conc_label(drug: str, conc: str, control: str = CONTROL) -> Column:
    c = F.col(conc)
    return F.when((F.col(drug) == control) | c.isNull(), F.col(drug)).otherwise(F.concat_ws("__", F.col(drug), c.cast("string")))


def safe_name(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), "/", "|"), " ", "_")


def snake_case(name: str) -> str:
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()


def rename_clean(df: DataFrame) -> DataFrame:
    """snake_case every column; a repeated result gets _2, _3, ..."""
    seen: dict[str, int] = {}
    names = []
    for n in map(snake_case, df.columns):
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def feature_class_tag(dim: DataFrame, name: str = "name") -> DataFrame:
    """Class and channel parsed from x.<channel>.<class>.<stat>."""
    parts = F.split(name, r"\.")
    letter = F.get(parts, F.lit(2))
    cls = F.coalesce(*[F.when(letter == k, F.lit(v)) for k, v in FEATURE_CLASSES.items()])
    return dim.withColumn("class", cls).withColumn("channel", F.get(parts, F.lit(1)))


def channel_feature_filter(dim: DataFrame, channel: str, channels: list[str]) -> DataFrame:
    """Features whose channel letters all belong to ``channels`` or to B, the one all share.

    Features of channel 0 (shape) have none of these letters and go.
    """
    allowed = F.array(*[F.lit(c) for c in [*channels, "B"]])
    return dim.where(F.size(F.array_except(F.split(channel, ""), allowed)) == 0)


def uuid_key(*parts: str) -> Column:
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])


def log_size(c: str) -> Column:
    return F.ln(c)


def relabel_conditional(df: DataFrame, column: str, condition: Column, value: str, text: str, pattern: str, replacement: str) -> DataFrame:
    """Set ``column`` where the condition holds and patch text in another column there."""
    out = df.withColumn(text, F.when(condition, F.regexp_replace(text, pattern, replacement)).otherwise(F.col(text)))
    return out.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def flag_wells_na(df: DataFrame, value: str, region: Column) -> DataFrame:
    """Null the value inside a plate region, keep the rows."""
    return df.withColumn(value, F.when(~F.coalesce(region, F.lit(False)), F.col(value)))


def exclude_keys(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*keys).distinct(), keys, "left_anti")


def viability_bins(c: str, step: float = 0.2, top: float = 1.0) -> Column:
    """Right-closed bins (0,.2], (.2,.4], ... and one open bin above ``top``."""
    edges = [round(step * i, 10) for i in range(int(round(top / step)) + 1)]
    x = F.col(c)
    cases = [F.when(x <= edges[0], F.lit(f"<={edges[0]:g}"))]
    cases += [F.when((x > a) & (x <= b), F.lit(f"({a:g},{b:g}]")) for a, b in zip(edges, edges[1:])]
    return F.coalesce(*cases, F.when(x > edges[-1], F.lit(f">{edges[-1]:g}")))


def string_group_tag(c: str, groups: dict[str, str], other: str | None = None) -> Column:
    """First matching pattern gives the tag."""
    return F.coalesce(*[F.when(F.col(c).rlike(p), F.lit(tag)) for tag, p in groups.items()], F.lit(other))


def pseudo_conc(drug: str, conc: str, value: float, control: str = CONTROL) -> Column:
    return F.when(F.col(drug) == control, F.lit(float(value))).otherwise(F.col(conc))


def reps_expand(df: DataFrame, reps: list[str], name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(r) for r in reps])))


def sample_name_parse(df: DataFrame, sample: str, pattern: str, names: list[str]) -> DataFrame:
    for i, n in enumerate(names):
        df = df.withColumn(n, F.regexp_extract(sample, pattern, i + 1))
    return df


def separate(df: DataFrame, column: str, into: list[str], sep: str | int) -> DataFrame:
    """Split one column into several by text (regex) or, for two, by position."""
    if isinstance(sep, int):
        head, tail = into
        c = F.col(column)
        return df.withColumn(head, F.substring(c, 1, sep)).withColumn(tail, F.substr(c, F.lit(sep + 1)))
    parts = F.split(column, sep)
    for i, n in enumerate(into):
        df = df.withColumn(n, F.get(parts, F.lit(i)))
    return df


def unite(df: DataFrame, name: str, columns: list[str], sep: str = "_") -> DataFrame:
    return df.withColumn(name, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns)


def fill_nulls(df: DataFrame, columns: list[str], value=0) -> DataFrame:
    return df.fillna(value, subset=columns)


def phenotype_tag(line: str, groups: dict[str, list], other: str = "other") -> Column:
    return F.coalesce(*[F.when(F.col(line).isin(members), F.lit(g)) for g, members in groups.items()], F.lit(other))


def exact2_filter(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs exactly twice."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select(*keys)
    return df.join(twice, keys, "left_semi")


def token_split_explode(df: DataFrame, column: str, name: str = "token", sep: str = r",\s*|/") -> DataFrame:
    """One row per lower-case token; empty tokens are dropped."""
    return df.withColumn(name, F.explode(F.split(F.lower(column), sep))).withColumn(name, F.trim(name)).where(F.col(name) != "")


def has_word(c: str, word: str) -> Column:
    return F.lower(F.col(c)).rlike(rf"\b{re.escape(word.lower())}\b")
