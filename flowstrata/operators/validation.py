"""Record validation: typed frames, and raw JSON lines read as VARIANT.

Both give the Bronze columns plus ``errors``, the reasons joined by ``; ``, empty
for a good record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.network import normalise_protocol
from ..functions.timestamps import as_instant, iso_text

_ADDRESS_DEFAULT = "0.0.0.0"
_DEFAULTS = {"src_ip": _ADDRESS_DEFAULT, "dst_ip": _ADDRESS_DEFAULT, "agent_id": ""}
# Whole number as text; group 1 is its integer part.
_INT_TEXT = r"^\s*([+-]?\d+)(?:\.0*)?\s*$"


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.concat_ws("; ", *[F.when(cond, F.lit(text)) for cond, text in checks])


def validate_records(df: DataFrame, default_agent: str = "") -> DataFrame:
    """Check a frame whose columns already have the Bronze types.

    Missing optional columns are filled with their defaults; unknown columns
    are kept as they are so that callers can carry keys along.
    """
    present = set(df.columns)
    out = df
    for field in schemas.BRONZE.fields:
        if field.name not in present:
            out = out.withColumn(field.name, F.lit(None).cast(field.dataType))
    errors = _reasons(
        (F.col("timestamp").isNull(), "timestamp: field required"),
        (F.col("length").isNull(), "length: field required"),
        (F.col("length") < 0, "length: must be greater than or equal to 0"),
    )
    return out.withColumn("errors", errors).withColumns({
        "src_ip": F.coalesce("src_ip", F.lit(_ADDRESS_DEFAULT)),
        "dst_ip": F.coalesce("dst_ip", F.lit(_ADDRESS_DEFAULT)),
        "protocol": normalise_protocol(F.col("protocol")),
        "agent_id": F.coalesce("agent_id", F.lit(default_agent)),
    })


def _whole_number(value: Column, kind: Column, target: T.DataType) -> Column:
    """Integer reading that also takes whole floats, numeric text and booleans."""
    type_name = target.simpleString()
    text = F.try_variant_get(value, "$", "string")
    exact = F.try_variant_get(value, "$", type_name)
    return (
        F.when(kind == "BIGINT", exact)
        .when(kind == "STRING", F.regexp_extract(text, _INT_TEXT, 1).try_cast(type_name))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast(type_name))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"),
              F.when(F.try_variant_get(value, "$", "double") % 1 == 0, exact))
    )


def _once(df: DataFrame, name: str) -> DataFrame:
    """Keeps later filters on ``name`` above its computation.

    Catalyst would otherwise push such a filter below the projections and
    evaluate the whole chain of parsing expressions in it a second time.
    """
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(F.col(name))).alias(name))


def validate_json(df: DataFrame, raw: str = "value", default_agent: str = "") -> DataFrame:
    """Check one JSON document per row. Keeps the other columns of ``df``.

    ``_rescued_data`` holds, as JSON, the fields that are unknown or whose value
    does not fit the column type (null when there are none).
    """
    fields = schemas.BRONZE.fields
    names = schemas.BRONZE.fieldNames()
    values = {n: F.col(f"_value_{n}") for n in names}
    kinds = {n: F.col(f"_kind_{n}") for n in names}

    # One step per projection, so that the document is parsed once per row and
    # every field is taken out of it once.
    parsed = df.withColumn("_json", F.try_parse_json(F.col(raw)))
    split = parsed.withColumns({
        **{f"_value_{n}": F.try_variant_get(F.col("_json"), f"$.{n}", "variant") for n in names},
        "_members": F.try_variant_get(F.col("_json"), "$", "map<string,variant>"),
    }).withColumns({f"_kind_{n}": F.schema_of_variant(values[n]) for n in names})

    typed: dict[str, Column] = {}
    for field in fields:
        name, value, kind = field.name, values[field.name], kinds[field.name]
        if name == "protocol":
            typed[name] = normalise_protocol(F.try_variant_get(value, "$", "string"))
        elif isinstance(field.dataType, T.StringType):
            typed[name] = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        else:
            typed[name] = _whole_number(value, kind, field.dataType)
    read = split.withColumns(typed)

    is_object = F.col("_members").isNotNull()
    misfits = {f.name: (kinds[f.name] != "VOID") & F.col(f.name).isNull() for f in fields if f.name != "protocol"}
    checks: list[tuple[Column, str]] = [(~is_object, "record: not a JSON object")]
    for field in fields:
        name, kind = field.name, kinds[field.name]
        if name in misfits:
            number = isinstance(field.dataType, T.IntegralType)
            problem = "must be an integer in range" if number else "must be a string"
            checks.append((misfits[name], f"{name}: {problem}"))
        if name in ("timestamp", "length"):
            checks.append((is_object & kind.isNull(), f"{name}: field required"))
        if name in ("timestamp", "length", "src_ip", "dst_ip", "agent_id"):
            checks.append((kind == "VOID", f"{name}: must not be null"))
        if name == "length":
            checks.append((F.col(name) < 0, "length: must be greater than or equal to 0"))

    misfit_names = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in misfits.items()])
    known_given = sum((F.when(kind.isNotNull(), 1).otherwise(0) for kind in kinds.values()), F.lit(0))
    judged = read.withColumns({
        "errors": _reasons(*checks),
        "_misfits": misfit_names,
        "_has_unknown": F.size("_members") > known_given,
    })
    # Looked into only where there is something to rescue.
    kept = F.map_filter(
        "_members", lambda key, _: ~key.isin(names) | F.array_contains(F.split("_misfits", ","), key)
    )
    rescued = F.when(F.col("_has_unknown") | (F.col("_misfits") != ""), F.nullif(F.to_json(kept), F.lit("{}")))
    out = judged.select(
        *df.columns,
        *[F.coalesce(n, F.lit(_DEFAULTS[n] if n != "agent_id" else default_agent)).alias(n) if n in _DEFAULTS else F.col(n)
          for n in names],
        rescued.alias("_rescued_data"),
        "errors",
    )
    return _once(out, "errors")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("errors") == "").drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("errors") != "")


def quarantine_rows(checked: DataFrame, raw: Column | None = None, as_of=None) -> DataFrame:
    """Rejected records as ``raw, reason, ts``.

    ``raw`` defaults to the record rebuilt as JSON from the Bronze columns.
    """
    if raw is None:
        raw = F.to_json(F.struct(*[F.col(f.name) for f in schemas.BRONZE.fields]))
    return rejected(checked).select(
        raw.alias("raw"),
        F.col("errors").alias("reason"),
        iso_text(as_instant(as_of)).alias("ts"),
    )
