"""Finding the lines of a document that carry a claim: ranking, budgets, a small selection, guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from veristrata.functions import text as T
from veristrata.operators import segment

#: Weight of a label's coverage, score of a line that holds the label, coverage from which a claim is supported.
LABEL_WEIGHT, LABEL_HELD, SUPPORTED = 0.95, 0.92, 0.72


def ranked_lines(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims(item_id, doc_id, quote, label) against each line of their own document, best line first.

    (item_id, doc_id, rank, ordinal, line_id, score, exact, quote_coverage, label_coverage, shared, targets, words): shared are the line's
    tokens among the claim's targets. Lines come out of the joined row, so after the join on doc_id only the ranking shuffles, by
    claim. A claim whose document is missing or has no line has no row.
    """
    rows = claims.select("item_id", "doc_id", "quote", "label", T.content_tokens(F.col("quote")).alias("q"), T.content_tokens(F.col("label")).alias("l")).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.select("item_id", "doc_id", "quote", "label", "q", "l", F.posexplode(segment.lines(F.col("text"))).alias("p", "line")).withColumn("t", T.content_tokens(F.col("line")))
    held = lambda c: F.coalesce((T.normal_loose(F.col(c)) != "") & T.normal_loose(F.col("line")).contains(T.normal_loose(F.col(c))), F.lit(False))
    rows = rows.withColumns({"quote_coverage": T.coverage(F.col("q"), F.col("t")), "label_coverage": T.coverage(F.col("l"), F.col("t")), "exact": held("quote"), "named": held("label")})
    score = F.greatest("quote_coverage", LABEL_WEIGHT * F.col("label_coverage"), F.col("exact").cast("double"), F.col("named").cast("double") * LABEL_HELD)
    targets = F.array_union("q", "l")
    rows = rows.select(
        "item_id", "doc_id", (F.col("p") + 1).alias("ordinal"), segment.line_id(F.col("p") + 1).alias("line_id"), score.alias("score"), "exact",
        "quote_coverage", "label_coverage", F.array_intersect(targets, "t").alias("shared"), targets.alias("targets"), "q", "l", F.size(T.word_tokens(F.col("line"))).alias("words"),
    )
    best = Window.partitionBy("item_id", "doc_id").orderBy(F.col("score").desc(), F.col("exact").desc(), F.col("quote_coverage").desc(), F.col("label_coverage").desc(), "ordinal")
    return rows.withColumn("rank", F.row_number().over(best))


def budget_curve(ranked: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, claims, supported, mean_coverage, mean_words): what the claims' first `budget` lines cover together."""
    own = ranked.filter(F.col("rank") <= max(budgets))
    together = lambda k: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("shared")))))
    by = own.groupBy("item_id", "doc_id").agg(F.first("q").alias("q"), *(together(k).alias(f"t{k}") for k in budgets), *(F.sum(F.when(F.col("rank") <= k, F.col("words"))).alias(f"w{k}") for k in budgets))
    long = by.select(F.explode(F.array(*(F.struct(F.lit(k).alias("budget"), T.coverage(F.col("q"), F.col(f"t{k}")).alias("c"), F.col(f"w{k}").alias("w")) for k in budgets))).alias("x")).select("x.*")
    return long.groupBy("budget").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("c") >= SUPPORTED).alias("supported"), F.round(F.avg("c"), 6).alias("mean_coverage"), F.round(F.avg("w"), 6).alias("mean_words"))


def risky(spans: Column, sections: Column, window: Column, words: Column, quote_coverage: Column, strict: bool = False) -> Column:
    """Whether a selection reaches too far for its size: strict limits, or limits that grow with the number of spans."""
    if strict:
        return (sections > 1) | (window > 40) | (spans > 3)
    return (sections > F.least(F.lit(3), spans)) | (window > 40 * spans) | (words > 24 * spans) | ((spans > 3) & (quote_coverage < 0.5))


def greedy(lines: list[dict], quote: set[str], label: set[str], most: int, words_each: int | None = 24, reach_each: int = 40) -> tuple[str, list[dict]]:
    """Up to `most` lines, each adding the most uncovered target tokens (ties: more per word, higher score, earlier line)."""
    chosen: list[dict] = []
    covered: set[str] = set()
    share = lambda want: len(want & covered) / len(want) if want else 0.0

    def fits(x: dict) -> bool:
        all_ = [*chosen, x]
        reach = max(y["ordinal"] for y in all_) - min(y["ordinal"] for y in all_) + 1
        return reach <= reach_each * len(all_) and (words_each is None or sum(y["words"] for y in all_) <= words_each * len(all_))

    while len(chosen) < most:
        open_ = [(len(new), len(new) / max(1, x["words"]), x["score"], -x["ordinal"], i) for i, x in enumerate(lines) if x not in chosen and (new := set(x["shared"]) - covered) and fits(x)]
        if not open_:
            break
        chosen.append(lines[max(open_)[-1]])
        covered |= set(chosen[-1]["shared"])
        if share(quote) >= SUPPORTED or share(label) >= SUPPORTED:
            return "supported", chosen
    return ("insufficient_evidence" if chosen else "not_found"), chosen


def select_minimal(ranked: DataFrame, most: int = 3, candidates: int | None = None, least: float = 0.08, words_each: int | None = 24) -> DataFrame:
    """(item_id, doc_id, status, line_ids): the few lines that support each claim, in reading order.

    Lines with a score of at least `least` are tried, all of them or a claim's best `candidates`, as a number asks for. Conflicts of
    assertion are not looked at here. A claim without such a line is not_found.
    """
    tried = F.col("score") >= least
    line = F.when(tried if candidates is None else tried & (F.col("rank") <= candidates), F.struct("ordinal", "line_id", "score", "words", "shared"))
    by = ranked.groupBy("item_id", "doc_id").agg(F.collect_list(line).alias("lines"), F.first("q").alias("q"), F.first("l").alias("l"))

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [greedy(sorted((dict(x) for x in r.lines), key=lambda x: x["ordinal"]), set(r.q), set(r.l), most, words_each) for r in p.itertuples()]
            yield pd.DataFrame({"item_id": p["item_id"], "doc_id": p["doc_id"], "status": [s for s, _ in got], "line_ids": [[x["line_id"] for x in sorted(c, key=lambda x: x["ordinal"])] for _, c in got]})

    kind = {f.name: f.dataType.simpleString() for f in by.schema}
    return by.mapInPandas(pick, f"item_id {kind['item_id']}, doc_id {kind['doc_id']}, status string, line_ids array<string>")


def length_density(rows: DataFrame, words: Column, items: Column, passed: Column, short: int = 1500, dense: float = 16) -> DataFrame:
    """Pass rates in the four cells of short or long texts by few or many items per thousand words."""
    length = F.when(words < short, "short").otherwise("long")
    density = F.when(items * 1000.0 / F.greatest(words, F.lit(1)) >= dense, "high").otherwise("low")
    t = rows.groupBy(length.alias("length"), density.alias("density")).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed"))
    low, high = T.wilson(F.col("passed"), F.col("n"))
    return t.select("length", "density", "n", "passed", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))
