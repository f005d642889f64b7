"""JSON whose fields have several types: parsed once, typed where the types agree and kept as variants where not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.session import stored

_VARIANT = "_variant"


def _fields(declared: str) -> list[tuple[str, str]]:
    """Names and types of ``OBJECT<name: TYPE, ...>`` as Spark writes the schema of a variant."""
    if not declared.startswith("OBJECT<"):
        return []
    body, out, depth, start, quoted = declared[7:-1], [], 0, 0, False
    for i, char in enumerate(body + ","):
        if char == "`":
            quoted = not quoted
        elif not quoted and char in "<(":
            depth += 1
        elif not quoted and char in ">)":
            depth -= 1
        elif not quoted and depth == 0 and char == ",":
            part = body[start:i].strip()
            start = i + 1
            if part.startswith("`"):
                end = part.index("`:", 1) if "`:" in part else len(part)
                out.append((part[1:end].replace("``", "`"), part[end + 2 :].strip()))
            elif part:
                name, kind = part.split(":", 1)
                out.append((name, kind.strip()))
    return out


def _kind(declared: str) -> str:
    """The SQL type of a variant's type: whole numbers and texts as they are, objects and what clashes as variant."""
    if declared.startswith("DECIMAL") or declared in ("BIGINT", "STRING", "BOOLEAN", "DOUBLE", "FLOAT", "DATE"):
        return declared.lower()
    if declared.startswith("ARRAY<"):
        inner = _kind(declared[6:-1])
        return f"array<{inner}>"
    return "variant"


def field(value: Column, name: str, kind: str) -> Column:
    """A field of a variant object; null if it is missing or of another type. Paths know no escapes, but two kinds of quotes."""
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None:
        inside = F.try_variant_get(value, "$", "map<string,variant>")[name]
        return inside if kind == "variant" else F.try_variant_get(inside, "$", kind)
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", kind)


def infer_variant(df: DataFrame, body: str) -> DataFrame:
    """``df`` with a column for each field of the JSON objects in ``body``, of the type that all rows agree on.

    A field whose types clash is a variant, and so is one that holds objects: no value becomes text or null for the sake of
    another. Every body is parsed once, into a variant that is stored; the common schema comes from one aggregation
    over it. A body that is no JSON has ``_corrupt`` true; a body that is no object has no fields. Names that ``df`` already has are refused.
    """
    parsed = stored(df.withColumn(_VARIANT, F.try_parse_json(F.col(body))), "variants")
    declared = parsed.agg(F.schema_of_variant_agg(F.when(F.expr(f"startswith(schema_of_variant({_VARIANT}), 'OBJECT')"), F.col(_VARIANT)))).first()[0]
    fields = _fields(declared or "")
    clash = sorted({n.lower() for n, _ in fields} & {c.lower() for c in df.columns})
    if clash:
        raise ValueError(f"the columns {', '.join(clash)} exist already")
    corrupt = (F.col(body).isNotNull() & F.col(_VARIANT).isNull()).alias("_corrupt")
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns], *[field(F.col(_VARIANT), n, _kind(k)).alias(n) for n, k in fields], corrupt)


def variant_columns(df: DataFrame) -> list[str]:
    """Columns whose types clashed."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]
