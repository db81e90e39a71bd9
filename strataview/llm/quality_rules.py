"""Quality rules: a threshold table compiled into Spark expressions, without user functions.

Every measure is a built-in expression over the whole text. ``RULES`` is the table; each
row names a measure and its least and greatest allowed value, and :func:`verdict`
compiles any such table into one boolean column.

Nulls and empty texts have no words, so they fail on ``n_words``. Repeated rows and ids
are judged row by row. :func:`quality_rules` returns the id and the measures only; other
columns of the input, even of the same names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by this are at "
    "de la le les et des en un une du que qui dans pour sur par pas "
    "der die das und ist nicht ein eine mit von zu den auch sich auf "
    "el los las y por con para del se una no es lo como"
).split()
WINDOW = 8
WHITE = "[ \\t-\\r]+"


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("too_short", "n_words", least=20),
    Rule("repeated_windows", "repeat_ratio", most=0.3),
    Rule("word_length", "mean_word_chars", least=1.5, most=20.0),
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("stop_words", "stop_ratio", least=0.02),
)


def _measured(df: DataFrame, text: Column, prefix: str = "q_") -> DataFrame:
    """``df`` with the measures beside its own columns, all named by ``prefix``."""
    p = prefix
    t = F.coalesce(text, F.lit(""))
    df = df.withColumns(
        {
            f"{p}w": F.filter(F.split(t, WHITE), lambda w: w != F.lit("")),
            f"{p}lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
            f"{p}n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
            f"{p}word_chars": F.length(F.regexp_replace(t, WHITE, "")).cast("long"),
        }
    )
    c = F.col
    df = df.withColumns(
        {
            f"{p}h": F.transform(c(f"{p}w"), lambda w: F.xxhash64(w)),
            f"{p}n_words": F.size(f"{p}w").cast("long"),
            f"{p}n_stop": F.size(F.filter(c(f"{p}w"), lambda w: w.isin(STOP_WORDS))).cast("long"),
            f"{p}n_lines": F.size(f"{p}lines").cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        }
    ).drop(f"{p}w", f"{p}lines")
    windows = F.transform(
        F.sequence(F.lit(0), c(f"{p}n_words").cast("int") - F.lit(WINDOW)),
        lambda i: F.xxhash64(*[F.get(c(f"{p}h"), i + F.lit(j)) for j in range(WINDOW)]),
    )
    df = df.withColumn(f"{p}win", F.when(c(f"{p}n_words") >= WINDOW, windows)).drop(f"{p}h")
    # Only texts in which a window occurs twice are sorted.
    again = F.size(F.array_distinct(f"{p}win")) < F.size(f"{p}win")
    df = df.withColumn(
        f"{p}s", F.when(again, F.array_sort(F.transform(c(f"{p}win"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    ).drop(f"{p}win")
    s = c(f"{p}s")
    df = df.withColumn(
        f"{p}at",
        F.array_sort(
            F.transform(
                F.filter(
                    s,
                    lambda e, i: (F.coalesce(F.get(s, i - 1)["x"] == e["x"], F.lit(False)))
                    | (F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))),
                ),
                lambda e: e["i"],
            )
        ),
    ).drop(f"{p}s")
    covered = F.aggregate(
        c(f"{p}at"),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    df = df.withColumn(f"{p}n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(f"{p}at")
    words, lines = F.greatest(c(f"{p}n_words"), F.lit(1)), F.greatest(c(f"{p}n_lines"), F.lit(1))
    return df.withColumns(
        {
            f"{p}repeat_ratio": c(f"{p}n_repeat_words") / words,
            f"{p}mean_word_chars": c(f"{p}word_chars") / words,
            f"{p}symbol_ratio": c(f"{p}n_symbols") / words,
            f"{p}dup_line_ratio": c(f"{p}n_dup_lines") / lines,
            f"{p}stop_ratio": c(f"{p}n_stop") / words,
            # Keeps a filter on the verdict above the measures; pushed below, it would repeat them all.
            f"{p}id": F.monotonically_increasing_id(),
        }
    )


def holds(r: Rule, prefix: str = "q_") -> Column:
    """True where one row of the table holds."""
    m, out = F.col(prefix + r.measure), F.lit(True)
    if r.least is not None:
        out = out & (m >= F.lit(r.least))
    if r.most is not None:
        out = out & (m <= F.lit(r.most))
    return out


def verdict(rules: tuple[Rule, ...] = RULES, prefix: str = "q_") -> Column:
    """True where every row of the table holds."""
    out = F.col(f"{prefix}id") >= 0
    for r in rules:
        out = out & holds(r, prefix)
    return out


MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop "
    "repeat_ratio mean_word_chars symbol_ratio dup_line_ratio stop_ratio"
).split()


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Per row: the id, all measures, ``failed`` (names of the broken rules) and ``kept``."""
    m = _measured(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text")).drop("text")
    failed = F.filter(
        F.array(*[F.when(~holds(r), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>"),
        lambda x: x.isNotNull(),
    )
    return m.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in MEASURES], failed.alias("failed"), verdict(rules).alias("kept"))


def keep_quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with its own columns: one projection and a filter.

    The input's columns travel in one struct, so names like ``q_n_words`` can't clash.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    return _measured(packed, F.col("text")).where(verdict(rules)).select("row.*")
