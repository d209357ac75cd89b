"""Registered queries: dataset records, exports, text noise."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import fixed_values as fv
from docketry.functions import draws
from docketry.operators import augment, shape
from docketry.operators.augment import augment_text
from docketry.plans import oracle_sql as sql
from docketry.plans.queries_eval import _CATEGORIES, _category_of
from docketry.session import work_folder
from docketry.sources import datasets
from docketry.sources.orders import receipts_from_orders, table


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("order_key")
    return receipts_from_orders(spark, sf_dir).withColumns(
        {
            "category": _category_of(F.col("customer_key")),
            "complexity": F.when(key % 3 == 0, "high").when(key % 3 == 1, "low"),
        }
    )


def _flat(records: DataFrame, key: Column, text: str, output: str, *more: Column) -> DataFrame:
    out = F.col(output)
    return records.select(
        key.alias("request_id"),
        F.sha2(F.col(text), 256).alias("text_hash"),
        out["vendor"].alias("vendor"),
        out["receipt_date"].alias("receipt_date"),
        out["category"].alias("category"),
        out["currency"].alias("currency"),
        F.size(out["items"]).alias("n_items"),
        out["total_amount"].cast("double").alias("total"),
        *more,
    )


_CATEGORY_LIST = "[" + ", ".join(sql.quoted(c) for c in _CATEGORIES) + "]"
_FLAT = f"""CAST(order_key AS VARCHAR) AS request_id, sha256({{text}}) AS text_hash, vendor,
  d AS receipt_date, {_CATEGORY_LIST}[custkey % {len(_CATEGORIES)} + 1] AS category,
  'AUD' AS currency, CAST(len(items) AS INTEGER) AS n_items, CAST(total AS DOUBLE) AS total"""
_COMPLEXITY = "CASE order_key % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS complexity"


def records_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = shape.training_records(_receipts(spark, sf_dir), noise_level=0.0, layout=False)
    return _flat(
        records, F.col("request_id"), "input", "output",
        F.col("metadata.complexity").alias("complexity"),
        F.col("metadata.noise_level").alias("noise_level"),
    )


_RECORDS_TRAINING = f"""
WITH {sql.RECEIPTS}
SELECT {_FLAT.format(text='receipt_text')}, {_COMPLEXITY}, 0.0::DOUBLE AS noise_level FROM txt
"""


def records_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = shape.evaluation_records(_receipts(spark, sf_dir), noise_level=0.0, layout=False)
    return _flat(
        records, F.col("request_id"), "receipt_text", "expected_output",
        F.to_json("evaluation_criteria").alias("criteria"),
    )


_RECORDS_EVALUATION = f"""
WITH {sql.RECEIPTS}
SELECT {_FLAT.format(text='receipt_text')},
  '{{"vendor_accuracy":true,"date_parsing":true,"amount_accuracy":true,"item_extraction":true,"categorization":true}}' AS criteria
FROM txt
"""


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = _receipts(spark, sf_dir)
    even = F.col("order_key") % 2 == 0
    return shape.union_sources(
        shape.dataset_records(receipts.filter(even), noise_level=0.0, layout=False, scenario="even"),
        shape.dataset_records(receipts.filter(~even), noise_level=0.0, layout=False, scenario="odd"),
    )


def records_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _datasets(spark, sf_dir)
    return _flat(
        records, F.col("request_id"), "receipt_text", "expected_output",
        F.col("metadata.scenario").alias("scenario"),
        (F.col("clean_text") == F.col("receipt_text")).alias("untouched"),
    )


_RECORDS_DATASET = f"""
WITH {sql.RECEIPTS}
SELECT {_FLAT.format(text="'Date: ' || d || chr(10) || receipt_text")},
  CASE WHEN order_key % 2 = 0 THEN 'even' ELSE 'odd' END AS scenario, TRUE AS untouched FROM txt
"""


def records_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that replay the dataset, joined to the receipts that answer them."""
    dataset = _datasets(spark, sf_dir).withColumn(
        "metadata", F.to_json(F.struct(F.col("request_id").alias("id"), "metadata.scenario"))
    )
    payloads = shape.prediction_payloads(dataset)
    answers = _receipts(spark, sf_dir).select(
        "request_id", "vendor", "receipt_date", "items", "total_amount",
        F.lit("AUD").alias("currency"), "category",
    )
    records = shape.prediction_records(payloads, answers)
    return _flat(
        records, F.col("request_id"), "receipt_text", "expected_output",
        F.col("metadata.dataset_id").alias("dataset_id"),
        (F.col("metadata.sample_id") == F.col("request_id")).alias("same_id"),
    )


_RECORDS_PREDICTION = f"""
WITH {sql.RECEIPTS}
SELECT {_FLAT.format(text="'Date: ' || d || chr(10) || receipt_text")},
  CASE WHEN order_key % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset_id, TRUE AS same_id FROM txt
"""


def records_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = shape.truth_records(_datasets(spark, sf_dir))
    return truth.select(
        "request_id", "vendor", "receipt_date", "category", "currency",
        F.size("items").alias("n_items"),
        *[F.col(f"{a}_amount").cast("double").alias(a) for a in ("subtotal", "gst", "total")],
    )


_RECORDS_TRUTH = f"""
WITH {sql.RECEIPTS}
SELECT CAST(order_key AS VARCHAR) AS request_id, vendor, d AS receipt_date,
  {_CATEGORY_LIST}[custkey % {len(_CATEGORIES)} + 1] AS category, 'AUD' AS currency,
  CAST(len(items) AS INTEGER) AS n_items, CAST(subtotal AS DOUBLE) AS subtotal,
  CAST(gst AS DOUBLE) AS gst, CAST(total AS DOUBLE) AS total FROM rec
"""


def json_export_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset written as JSON lines and read back with the record schema.

    The lines repeat names and texts; compressed they are a fraction of the bytes."""
    folder = f"{work_folder(spark, 'export')}/dataset.jsonl"
    datasets.write_records(_datasets(spark, sf_dir), folder, compression="lz4")
    records = datasets.read_records(spark, folder)
    return _flat(
        records, F.col("request_id"), "receipt_text", "expected_output",
        F.col("metadata.scenario").alias("scenario"),
    )


_JSON_EXPORT_RELOAD = f"""
WITH {sql.RECEIPTS}
SELECT {_FLAT.format(text="'Date: ' || d || chr(10) || receipt_text")},
  CASE WHEN order_key % 2 = 0 THEN 'even' ELSE 'odd' END AS scenario FROM txt
"""


# --- noise -----------------------------------------------------------------------------

def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", "text")


_KEY = ["conv_id", "turn"]
_SEED = 7


def _noised(spark: SparkSession, sf_dir: str, level: float, **how) -> DataFrame:
    """The turns with their text noised, which is what is compared."""
    return augment_text(_turns(spark, sf_dir), "text", _KEY, noise_level=level, seed=_SEED, **how)


def augment_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noised(spark, sf_dir, 0.0)


def augment_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the words get letters of the other case."""
    return _noised(spark, sf_dir, 0.5, modes=("case",))


def augment_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alikes replace letters in half the words."""
    return _noised(spark, sf_dir, 0.5, modes=("substitute",))


def augment_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the words lose one or two letters."""
    return _noised(spark, sf_dir, 0.5, modes=("missing",))


def augment_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the words gain one or two characters."""
    return _noised(spark, sf_dir, 0.5, modes=("extra",))


def augment_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines widened or broken in two."""
    return _noised(spark, sf_dir, 0.0, layout=True)


def augment_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All modes with layout noise at the default rate."""
    return _noised(spark, sf_dir, 0.1, layout=True)


def augment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise by keys that are text, and that may be NULL."""
    turns = _turns(spark, sf_dir).withColumn(
        "name", F.when(F.col("turn") != 1, F.concat_ws("/", F.col("conv_id"), F.col("turn")))
    )
    return augment_text(turns, "text", "name", noise_level=0.5, seed=_SEED, modes=("substitute",)).drop("name")


class _SqlDraws:
    """The draws of :mod:`docketry.functions.draws` as SQL."""

    def __init__(self, counter: str = "0::BIGINT"):
        self.counter = counter

    def at(self, *path) -> "_SqlDraws":
        counter = self.counter
        for step in path:
            counter = f"(({counter} * {draws.PATH_STEP} + {step} + 1) % {draws.PRIME})"
        return _SqlDraws(counter)

    def number(self) -> str:
        return f"list_transform([(state + {self.counter} * {draws.COUNTER_STEP}) % {draws.PRIME}], lambda x: {_fifth('x')})[1]"

    def uniform(self) -> str:
        return f"({self.number()} / {draws.PRIME}::DOUBLE)"

    def below(self, n) -> str:
        return f"CAST(floor({self.number()} * {n} / {draws.PRIME}::DOUBLE) AS BIGINT)"


def _fifth(x: str) -> str:
    square = f"({x} * {x} % {draws.PRIME})"
    return f"({square} * {square} % {draws.PRIME} * {x} % {draws.PRIME})"


def _folded(*numbers: str) -> str:
    """The state of a row from the numbers of its keys."""
    each = ", ".join(f"coalesce({n}, {draws.PRIME - 1})" for n in numbers)
    step = _fifth(f"((h * {draws.KEY_STEP} + v + 1) % {draws.PRIME})")
    return f"list_reduce([{_SEED}::BIGINT, {each}], lambda h, v: {step})"


def _named(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` under a name."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _sql_substitute(word: str, at: _SqlDraws) -> str:
    table = " ".join(f"WHEN '{c}' THEN {others!r}" for c, others in fv.LOOK_ALIKES.items())
    here = at.at("(j - 1)")
    swapped = _named(
        f"CASE ch {table} END", "o",
        f"CASE WHEN o IS NOT NULL AND {here.at(augment.SWAP).uniform()} < {augment.SUBSTITUTE_RATE}::DOUBLE "
        f"THEN o[{here.at(augment.WHICH).below('len(o)')} + 1] ELSE ch END",
    )
    return f"array_to_string(list_transform(regexp_extract_all({word}, '(?s).'), lambda ch, j: {swapped}), '')"


def _sql_missing(word: str, at: _SqlDraws) -> str:
    first, rest = at.at(augment.FIRST).below("length(w)"), at.at(augment.SECOND).below("(length(w) - 1)")
    two = f"{at.at(augment.COUNT).below(2)} = 1"
    second = "CASE WHEN d.r >= d.f THEN d.r + 1 ELSE d.r END"
    kept = (
        f"array_to_string(list_filter(regexp_extract_all({word}, '(?s).'), lambda ch, j: "
        f"j - 1 <> d.f AND NOT (d.two AND j - 1 = {second})), '')"
    )
    drawn = _named(f"{{'f': {first}, 'r': {rest}, 'two': {two}}}", "d", kept)
    return f"CASE WHEN length({word}) <= 2 THEN {word} ELSE {drawn} END"


def _sql_insert(word: str, at: _SqlDraws) -> str:
    extra = f"{list(fv.EXTRA_CHARACTERS)!r}[{at.at(augment.WHICH).below(len(fv.EXTRA_CHARACTERS))} + 1]"
    return _named(
        at.at(augment.PLACE).below(f"(length({word}) + 1)"), "p", f"{word}[:p] || {extra} || substr({word}, p + 1)"
    )


def _sql_extra(word: str, at: _SqlDraws) -> str:
    again = f"CASE WHEN {at.at(augment.COUNT).below(2)} = 1 THEN {_sql_insert('once', at.at(2))} ELSE once END"
    return _named(_sql_insert(word, at.at(1)), "once", again)


def _sql_case(word: str, at: _SqlDraws) -> str:
    flipped = (
        "CASE WHEN ch = 'ß' THEN 'SS' WHEN regexp_matches(ch, '\\p{Ll}') THEN upper(ch) ELSE lower(ch) END"
    )
    return (
        f"array_to_string(list_transform(regexp_extract_all({word}, '(?s).'), lambda ch, j: "
        f"CASE WHEN {at.at('(j - 1)').uniform()} < {augment.CASE_RATE}::DOUBLE THEN {flipped} ELSE ch END), '')"
    )


_SQL_MODES = {"substitute": _sql_substitute, "missing": _sql_missing, "extra": _sql_extra, "case": _sql_case}


def _sql_words(text: str, level: float, modes: tuple[str, ...]) -> str:
    here = _SqlDraws().at(augment.WORDS, "(i - 1)")
    by = " ".join(
        f"WHEN {k} THEN {_SQL_MODES[name]('w', here.at(augment.MODES.index(name)))}" for k, name in enumerate(modes)
    )
    return (
        f"array_to_string(list_transform(string_split(trim(regexp_replace({text}, '\\s+', ' ', 'g')), ' '), "
        f"lambda w, i: CASE WHEN {here.at(augment.GATE).uniform()} < {level}::DOUBLE "
        f"THEN CASE {here.at(augment.MODE).below(len(modes))} {by} END ELSE w END), ' ')"
    )


def _sql_layout(text: str) -> str:
    here = _SqlDraws().at(augment.LAYOUT, "(i - 1)")
    cut = f"({here.at(augment.CUT).below('(len(ws) - 1)')} + 1)"
    broken = _named(
        "string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ')", "ws",
        "CASE WHEN len(ws) > 2 THEN " + _named(
            cut, "c", "array_to_string(ws[:c], ' ') || chr(10) || array_to_string(ws[c + 1:], ' ')"
        ) + " ELSE line END",
    )
    widened = "regexp_replace(line, '([\\p{L}\\p{N}_])', '\\1  ', 'g')"
    return (
        f"array_to_string(list_transform(string_split({text}, chr(10)), lambda line, i: "
        f"CASE WHEN {here.at(augment.LINE).uniform()} < {augment.LAYOUT_RATE}::DOUBLE THEN "
        f"CASE WHEN {here.at(augment.KIND).uniform()} < {augment.LAYOUT_SPACE_RATE}::DOUBLE THEN {widened} "
        f"ELSE {broken} END ELSE line END), chr(10))"
    )


def _sql_noise(text: str, state: str = _folded(*[f"((({k} % {draws.PRIME}) + {draws.PRIME}) % {draws.PRIME})" for k in _KEY])) -> str:
    return (
        f"SELECT conv_id, turn, {text} AS text FROM (SELECT conv_id, turn, text, {state} AS state FROM conversations)"
    )


_AUGMENT_IDENTITY = "SELECT conv_id, turn, text FROM conversations"
_AUGMENT = {name: _sql_noise(_sql_words("text", 0.5, (name,))) for name in _SQL_MODES}
_AUGMENT_LAYOUT = _sql_noise(_sql_layout("text"))
_AUGMENT_MIXED = f"""
SELECT conv_id, turn, {_sql_layout("noised")} AS text
FROM (SELECT *, {_sql_words("text", 0.1, augment.MODES)} AS noised
      FROM (SELECT *, {_folded("conv_id", "turn")} AS state FROM conversations))
"""
_AUGMENT_KEYS = _sql_noise(
    _sql_words("text", 0.5, ("substitute",)),
    _folded("CASE WHEN turn <> 1 THEN ('0x' || md5(conv_id || '/' || turn)[:7])::BIGINT END"),
)


QUERIES = {
    "records_training": (records_training, _RECORDS_TRAINING),
    "records_evaluation": (records_evaluation, _RECORDS_EVALUATION),
    "records_dataset": (records_dataset, _RECORDS_DATASET),
    "records_prediction": (records_prediction, _RECORDS_PREDICTION),
    "records_truth": (records_truth, _RECORDS_TRUTH),
    "json_export_reload": (json_export_reload, _JSON_EXPORT_RELOAD),
    "augment_identity": (augment_identity, _AUGMENT_IDENTITY),
    "augment_case": (augment_case, _AUGMENT["case"]),
    "augment_substitute": (augment_substitute, _AUGMENT["substitute"]),
    "augment_missing": (augment_missing, _AUGMENT["missing"]),
    "augment_extra": (augment_extra, _AUGMENT["extra"]),
    "augment_layout": (augment_layout, _AUGMENT_LAYOUT),
    "augment_mixed": (augment_mixed, _AUGMENT_MIXED),
    "augment_keys": (augment_keys, _AUGMENT_KEYS),
}
