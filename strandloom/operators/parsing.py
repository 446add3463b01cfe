"""Numbered lines to record tables: dispatch, model state, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import infer_symbol
from ..functions.fields import cut, numbers, prefix_integer
from .scan import running

#: States beyond all model numbers: after ENDMDL, and in a model without number.
OUTSIDE, UNNAMED = 1 << 40, 1 << 41


def records(lines: DataFrame) -> DataFrame:
    """Lines of six characters or more with their upper-cased record type."""
    return lines.filter(F.length("line") >= 6).withColumn("record", F.upper(F.rtrim(cut(F.col("line"), 0, 6))))


def with_model(lines: DataFrame, model: int | None = None) -> DataFrame:
    """Records with the model they stand in (null outside) and ``accepted``: before any MODEL record, or inside the
    selected model. The selection is ``model``, or the number of the structure's first MODEL record."""
    recs = records(lines)
    is_model = F.col("record") == "MODEL"
    named = prefix_integer(cut(F.col("line"), 10, 14))
    # a state per MODEL or ENDMDL record, as a number: states in structs would make the summary of blocks sort all lines
    number = F.coalesce(named.cast("long"), F.lit(UNNAMED))
    state = F.when(is_model, number).when(F.col("record") == "ENDMDL", F.lit(OUTSIDE))
    first = F.when(is_model, number)
    recs = running(recs, ["structure_id"], "line_no", {"model_count": ("sum", is_model.cast("int")), "state": ("last", state)}, {"first_model": ("first", first)})
    # a MODEL record without number counts as its place among them, and nothing has changed that count since
    unnamed = F.when(F.col("state") == UNNAMED, F.col("model_count").cast("int"))
    recs = recs.withColumn("model", unnamed.when(F.col("state") != OUTSIDE, F.col("state").cast("int")))
    chosen = F.lit(model) if model is not None else F.when(F.col("first_model").isNotNull(), F.when(F.col("first_model") == UNNAMED, 1).otherwise(F.col("first_model").cast("int")))
    recs = recs.withColumn("selected", chosen)
    return recs.withColumn("accepted", (F.col("model_count") == 0) | F.coalesce(F.col("model") == F.col("selected"), F.lit(False))).drop("state", "first_model")


def atoms_raw(recs: DataFrame) -> DataFrame:
    """Accepted ATOM and HETATM records with fields. Rows without coordinates are left out (see ``coordinate_warnings``)."""
    return atom_fields(recs).filter("x is not null and y is not null and z is not null")


def atom_fields(recs: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = recs.filter(F.col("record").isin("ATOM", "HETATM") & F.col("accepted"))
    chain = F.when(F.trim(cut(line, 21, 22)) == "", " ").otherwise(cut(line, 21, 22))
    name = cut(line, 12, 16)
    whole = F.transform(F.array(cut(line, 6, 11), cut(line, 22, 26)), lambda t: F.coalesce(prefix_integer(t), F.lit(0)))
    decimal = numbers(*[cut(line, a, b) for a, b in ((30, 38), (38, 46), (46, 54), (54, 60), (60, 66))])
    # exploded, so that a filter of coordinates reads what was parsed instead of parsing again
    rows = rows.select("structure_id", "line_no", "record", "line", F.inline(F.array(F.struct(whole.alias("whole"), decimal.alias("decimal")))))
    return rows.select(
        "structure_id", "line_no", (F.col("record") == "HETATM").alias("hetero"),
        F.col("whole")[0].alias("serial"), name.alias("name"), F.trim(cut(line, 16, 17)).alias("alt_loc"), F.trim(cut(line, 17, 20)).alias("res_name"),
        chain.alias("chain_id"), F.col("whole")[1].alias("res_seq"), F.trim(cut(line, 26, 27)).alias("icode"),
        *[F.col("decimal")[n].alias(c) for n, c in enumerate(("x", "y", "z", "occupancy", "b_factor"))], infer_symbol(cut(line, 76, 78), name).alias("element"),
    )


def coordinate_warnings(recs: DataFrame) -> DataFrame:
    rows = atom_fields(recs).filter("x is null or y is null or z is null")
    return rows.select("structure_id", F.format_string("Line %d: missing coordinates, atom skipped", "line_no").alias("warning"))


def model_counts(recs: DataFrame) -> DataFrame:
    """structure_id, model_count (1 at least), selected."""
    return recs.groupBy("structure_id").agg(F.greatest(F.lit(1), F.max("model_count")).cast("int").alias("model_count"), F.first("selected", ignorenulls=True).alias("selected"))


def conect_mentions(recs: DataFrame) -> DataFrame:
    """structure_id, lo, hi, mentions of serial pairs, both directions together; zeros and self-links are skipped."""
    line = F.col("line")
    base = prefix_integer(cut(line, 6, 11))
    partners = F.array(*[prefix_integer(cut(line, s, s + 5)) for s in (11, 16, 21, 26)])
    rows = recs.filter(F.col("record") == "CONECT").select("structure_id", base.alias("base"), F.explode(partners).alias("partner"))
    rows = rows.filter("base is not null and base <> 0 and partner is not null and partner <> 0 and base <> partner")
    return rows.groupBy("structure_id", F.least("base", "partner").alias("lo"), F.greatest("base", "partner").alias("hi")).agg(F.count("*").alias("mentions"))


def _first_chain(line: Column, *places: int) -> Column:
    found = F.lit(" ")
    for p in reversed(places):
        found = F.when(F.trim(cut(line, p, p + 1)) != "", cut(line, p, p + 1)).otherwise(found)
    return found


def secondary_records(recs: DataFrame) -> DataFrame:
    """structure_id, line_no, kind, chain_id, start_seq, end_seq of HELIX and SHEET records."""
    line = F.col("line")
    helix = recs.filter(F.col("record") == "HELIX").select("structure_id", "line_no", F.lit("helix").alias("kind"), _first_chain(line, 19).alias("chain_id"), prefix_integer(cut(line, 21, 26)).alias("start_seq"), prefix_integer(cut(line, 33, 38)).alias("end_seq"))
    sheet_start = F.coalesce(prefix_integer(cut(line, 22, 27)), prefix_integer(cut(line, 21, 26)))
    sheet = recs.filter(F.col("record") == "SHEET").select("structure_id", "line_no", F.lit("sheet").alias("kind"), _first_chain(line, 21, 20).alias("chain_id"), sheet_start.alias("start_seq"), prefix_integer(cut(line, 33, 38)).alias("end_seq"))
    return helix.unionByName(sheet).filter("start_seq is not null and end_seq is not null")


def terminators(recs: DataFrame) -> DataFrame:
    """structure_id, line_no, chain_id of accepted TER records; a blank chain is null."""
    return recs.filter((F.col("record") == "TER") & F.col("accepted")).select("structure_id", "line_no", F.nullif(F.trim(cut(F.col("line"), 21, 22)), F.lit("")).alias("chain_id"))
