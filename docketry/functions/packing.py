"""Records as short rows, for steps that shuffle and sort them.

A record with a list of items is a row of many small fields, each padded and with an
offset of its own.  The texts of a record written as one JSON array, and its items as
another, take about a third less when shuffled, and come back as they were.  Bytes that
are no UTF-8 come back as U+FFFD, which lower-casing makes of them too.
"""

from pyspark.sql import DataFrame, functions as F, types as T

_TEXT = T.StringType()
#: A text that cannot be read back ends the job; none is too long.
_EXACT = {"mode": "FAILFAST", "maxStringLen": str(2**31 - 1)}


def _texts(kind: T.StructType) -> list[str]:
    return [f.name for f in kind if f.dataType == _TEXT]


def _lists(kind: T.StructType) -> dict[str, list[str]]:
    """Names of the fields that are lists of structs of texts, with the names in them."""
    return {
        f.name: f.dataType.elementType.names
        for f in kind
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        and f.dataType.elementType.names == _texts(f.dataType.elementType)
    }


def packed(rows: DataFrame, name: str) -> DataFrame:
    """The struct ``name`` with its texts and each list of texts as JSON arrays.

    Fields of other types are kept as they are."""
    kind, record = rows.schema[name].dataType, F.col(name)
    texts, lists = _texts(kind), _lists(kind)

    def inner(names: list[str]):
        return lambda item: F.when(item.isNotNull(), F.array(*[item[n] for n in names]))

    parts = [record[f].alias(f) for f in kind.names if f not in texts and f not in lists]
    parts += [F.to_json(F.transform(record[f], inner(names))).alias(f) for f, names in lists.items()]
    texts_part = F.to_json(F.array(*[record[f] for f in texts])) if texts else F.lit(None).cast(_TEXT)
    return rows.withColumn(name, F.when(record.isNotNull(), F.struct(texts_part.alias("_texts"), *parts)))


def unpacked(rows: DataFrame, name: str, kind: T.StructType) -> DataFrame:
    """The struct ``name`` as it was before :func:`packed`; NULL stays NULL."""
    record, texts, lists = F.col(name), _texts(kind), _lists(kind)
    at = f"_{name}_"
    read = {f"{at}texts": F.from_json(record["_texts"], "array<string>", _EXACT)}
    read |= {f"{at}{f}": F.from_json(record[f], "array<array<string>>", _EXACT) for f in lists}

    def inner(names: list[str]):
        return lambda item: F.when(
            item.isNotNull(), F.struct(*[F.get(item, F.lit(i)).alias(n) for i, n in enumerate(names)])
        )

    def field(f: str):
        if f in texts:
            return F.get(f"{at}texts", F.lit(texts.index(f)))
        return F.transform(f"{at}{f}", inner(lists[f])) if f in lists else record[f]

    whole = F.struct(*[field(f).alias(f) for f in kind.names])
    return rows.withColumns(read).withColumn(name, F.when(record.isNotNull(), whole)).drop(*read)
