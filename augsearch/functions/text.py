"""Identifier rules and string functions as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The separator of a column id and its escaped form.
SEPARATOR, ESCAPED = "::", ":\\:"


def sanitize(name: Column) -> Column:
    """A column name that holds no separator: `*` as `\\*`, `::` as `:\\:`, and `^...$` between backslashes."""
    r = F.replace(name, F.lit(SEPARATOR), F.lit(ESCAPED))
    return F.when(name == "*", "\\*").when(r.startswith("^") & r.endswith("$"), F.concat(F.lit("\\"), r, F.lit("\\"))).otherwise(r)


def sanitize_str(name: str) -> str:
    if name == "*":
        return "\\*"
    r = name.replace(SEPARATOR, ESCAPED)
    return f"\\{r}\\" if r.startswith("^") and r.endswith("$") else r


def column_id(table: Column, name: Column) -> Column:
    """The id of a column; the name is sanitized here, exactly once."""
    return F.concat_ws(SEPARATOR, table, sanitize(name))


def table_of(id_: Column, which: str = "last") -> Column:
    """The table of a column id: what stands before its last (joins) or first (unions, ground truth) separator."""
    return F.substring_index(id_, SEPARATOR, 1) if which == "first" else F.when(F.instr(id_, SEPARATOR) == 0, id_).otherwise(F.regexp_extract(id_, "(?s)^(.*)::", 1))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Lower case, each run of white space as one underscore."""
    return F.regexp_replace(F.lower(strip(text)), r"\s+", "_")


@F.pandas_udf(StringType())
def two_decimals(x: pd.Series) -> pd.Series:
    """As C's %.2f: Spark's own format rounds halves of the decimal digits, not of the number."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.2f}")


def short_name(name: Column, most: int = 180) -> Column:
    """A name of at most `most` characters: a longer one is cut and ends in 8 digits of its hash."""
    return F.when(F.char_length(name) > most, F.concat(F.substring(name, 1, most - 9), F.lit("-"), F.substring(F.sha2(name, 256), 1, 8))).otherwise(name)


def pipeline_name(model: Column, strategy: Column) -> Column:
    return F.replace(F.lower(F.concat_ws("-", model, strategy)), F.lit("."), F.lit("_"))


def experiment_name(dataset: str, model: str, views: list[str]) -> str:
    ends = views[0] if len(views) == 1 else f"{views[0]}~{views[-1]}"
    return f"{dataset}-{model}-v={len(views)}-{ends}"


def unit_of(path: Column) -> Column:
    """A number in [0, 1) from the first 8 bytes of the path's SHA-1."""
    return F.conv(F.substring(F.sha1(path), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_split(path: Column, train: float = 0.8, val: float = 0.1) -> Column:
    u = unit_of(path)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def n_tokens(text: Column) -> Column:
    """Words and punctuation marks, for models without a tokenizer of their own."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_\s])"), F.lit(1)))
