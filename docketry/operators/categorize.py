"""Keyword categorisation of receipts."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry import fixed_values as fv
from docketry import schemas
from docketry.functions.items import item_names

CONFIDENT = 0.8
#: Letters of a keyword that it is looked up by.
GRAM = 3


def rules_table(spark: SparkSession) -> DataFrame:
    """The keyword catalogue as a table."""
    rows = [
        (c, category, k, keyword)
        for c, (category, keywords) in enumerate(fv.CATEGORY_KEYWORDS.items())
        for k, keyword in enumerate(keywords)
    ]
    return spark.createDataFrame(rows, schemas.RULES)


def search_text(vendor: Column, items: Column, text: Column) -> Column:
    """Lower-case text the keywords are looked up in."""
    names = F.array_join(
        F.coalesce(item_names(items), F.array().cast("array<string>")), " ", ""
    )
    return F.lower(F.concat_ws(" ", F.coalesce(vendor, F.lit("")), names, text))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_best_category(
    rows: DataFrame, text: str, name: str, rules: dict[str, list[str]] | None = None
) -> DataFrame:
    """Add a struct ``n, place, category, keywords`` of the category with most keywords.

    Keywords count once, as substrings of the column named ``text``; ties go to
    the earlier category.  The catalogue is part of the expression: no join, no
    explode.  It is written as SQL because one call per keyword and function
    would cost more driver time than planning the query.

    The keywords of all categories are only counted, in an expression without
    lambdas, which Spark compiles; with a lambda around it, it would be
    interpreted.  Those of the best category are then listed.
    """
    catalogue = fv.CATEGORY_KEYWORDS if rules is None else rules
    size, top = len(catalogue), f"{name}_top"

    def rank(place: int, keywords: list[str]) -> str:
        # a word more weighs more than all places; the earlier place is the larger number
        hits = " + ".join(
            f"if(contains({text}, {_sql_text(k.lower())}), {size}L, 0L)" for k in keywords
        )
        return f"{hits or '0L'} + {size - 1 - place}L"

    def words(keywords: list[str]) -> str:
        pairs = ", ".join(
            f"struct({_sql_text(k.lower())} as low, {_sql_text(k)} as shown)" for k in keywords
        )
        none = "cast(array() as array<struct<low:string,shown:string>>)"
        return f"array({pairs})" if keywords else none

    ranks = ", ".join(rank(i, kws) for i, kws in enumerate(catalogue.values()))
    names = ", ".join(_sql_text(c) for c in catalogue)
    lists = ", ".join(words(kws) for kws in catalogue.values())
    place = f"cast({size - 1} - {top} % {size} as int)"
    best = F.expr(
        f"struct(cast({top} div {size} as int) as n, -{place} as place, "
        f"get(array({names}), {place}) as category, "
        f"transform(filter(get(array({lists}), {place}), k -> contains({text}, k.low)), "
        "k -> k.shown) as keywords)"
    )
    return rows.withColumn(top, F.expr(f"array_max(array({ranks}))")).withColumn(name, best).drop(top)


def best_by_table(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``_text_key, _best`` for each distinct ``_text_key, _search`` with a keyword
    of the rule table; ``_best`` as of :func:`with_best_category`.

    A keyword is looked up by its first ``GRAM`` letters among those of the text,
    an equality join that the size of either side does not limit, then checked.
    """
    asked = rules.select(
        "cat_order", "category", "kw_order", "keyword", F.lower("keyword").alias("_word")
    ).filter("_word != ''")
    asked = asked.withColumn("_gram", F.substring("_word", 1, GRAM))
    size = F.char_length("_search")

    def grams(letters: int):
        places = F.sequence(F.lit(1), F.greatest(size - letters + 1, F.lit(1)))
        return F.transform(places, lambda i: F.substr(F.col("_search"), i, F.lit(letters)))

    every = F.array_distinct(F.concat(*[grams(n) for n in range(1, GRAM + 1)]))
    spread = texts.select("_text_key", "_search", F.explode(every).alias("_gram"))
    hits = spread.join(asked, "_gram").filter(F.contains("_search", F.col("_word")))
    by_category = hits.groupBy("_text_key", "cat_order", "category").agg(
        F.array_sort(F.collect_set(F.struct("kw_order", "keyword"))).alias("found")
    )
    found = F.struct(
        F.size("found").alias("n"), (-F.col("cat_order")).alias("place"), F.col("category"),
        F.col("found.keyword").alias("keywords"),
    )
    return by_category.groupBy("_text_key").agg(F.max(found).alias("_best"))


def categorize(
    receipts: DataFrame,
    rules: dict[str, list[str]] | None = None,
    text_col: str = "clean_text",
    model_category: str | None = None,
    rule_table: DataFrame | None = None,
) -> DataFrame:
    """Add category, source, reason, matched keywords and category confidence.

    Rules decide when confident.  Otherwise a category from the optional
    ``model_category`` column is taken, then weaker rule evidence, then
    ``Unclassified``.  ``rules`` are part of the plan; a ``rule_table``
    (``cat_order, category, kw_order, keyword``) of any size is joined instead.
    """
    found = receipts.withColumn(
        "_search", search_text(F.col("vendor"), F.col("items"), F.col(text_col))
    )
    if rule_table is None:
        found = with_best_category(found, "_search", "_best", rules)
    else:
        found = found.withColumn("_text_key", F.sha2("_search", 256))
        texts = found.groupBy("_text_key").agg(F.first("_search").alias("_search"))
        found = found.join(best_by_table(texts, rule_table), "_text_key", "left").drop("_text_key")
    found = found.withColumn(
        "_by_rules", F.least(F.coalesce("_best.n", F.lit(0)) * F.lit(0.3), F.lit(1.0))
    )
    best = F.col("_best")
    any_hit = F.coalesce(best["n"] > 0, F.lit(False))
    by_model = F.lit(False)
    model = F.lit(None).cast("string")
    if model_category is not None:
        model = F.col(model_category)
        by_model = F.coalesce(F.lower(model) != "unclassified", F.lit(False)) & (
            F.col("_by_rules") < CONFIDENT
        )
    none = F.array().cast("array<string>")
    return found.withColumns(
        {
            "category": F.when(by_model, model)
            .when(any_hit, best["category"])
            .otherwise("Unclassified"),
            "categorization_source": F.when(by_model, "ai")
            .when(any_hit, "rules")
            .otherwise("fallback"),
            "categorization_reason": F.when(by_model, "Category from model output")
            .when(
                any_hit,
                F.concat(F.lit("Matched keywords: "), F.array_join(best["keywords"], ", ")),
            )
            .otherwise("No clear categorization found"),
            "matched_keywords": F.when(~by_model & any_hit, best["keywords"]).otherwise(none),
            "category_confidence": F.when(by_model, 0.5)
            .when(any_hit, F.col("_by_rules"))
            .otherwise(0.0),
        }
    ).drop("_search", "_best", "_by_rules")
