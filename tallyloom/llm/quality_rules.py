"""Quality rules by host: failures aggregated by domain, rates shrunk by an empirical beta prior, verdicts joined back.

Each document is measured with built-in functions only. A base rule (few words, repeats) that fails counts against the document's
host; symbols, repeated lines and long words are measured and counted by host, and enter neither its rate nor a verdict. Over all hosts
a beta prior is fitted to the rates by moments; a host whose shrunken rate of base failures reaches `reject_rate` loses
all its documents, and others lose only those that fail the base rules.

Defined results: a null or blank text has no words and fails; a null host stands for no host and gets no verdict;
repeated rows count each, and rows that share an id are judged each by its own text and host; an empty table gives an empty result; extra
columns pass through `drop_failing`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, id_key, materialize, named_as, plain, text_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: rules beside the base ones, which count in a host's report only
    max_symbols_percent: int = 10
    max_dup_lines: int = 10
    max_mean_word: int = 30
    #: a host with a shrunken failure rate from here on is rejected
    reject_rate: float = 0.6


def _let(value: Column, body) -> Column:
    """Bind an array or scalar once and use it in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text.

    Windows are told apart by hashes first; only a text with two equal hashes compares and sorts the windows themselves.
    """
    last = F.size(words) - WINDOW

    def windows(make) -> Column:
        return F.transform(F.sequence(F.lit(0), last), make)

    def covered(w: Column) -> Column:
        grams = windows(lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("at")))
        twice = _let(F.sort_array(grams), lambda s: F.filter(s, lambda x, k: ((k > 0) & (x["g"] == F.get(s, k - 1)["g"])) | F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["at"]))
        return _let(
            places,
            lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x),
        )

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: windows(lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    any_twice = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((last >= 1) & F.when(last >= 1, any_twice), covered(words)).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """A row for each document: id, host, the counts, and the rules that fail."""
    own, id_, host, text = plain(docs, id_col, host_col, text_col)
    t = own.select(id_.alias("id"), host.alias("host"), text_of(text).alias("t"))
    t = t.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    t = t.select(
        "id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS + "+", ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
    )
    few = F.col("n_words") < rules.min_words
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    return t.select(
        "*",
        few.alias("few_words"),
        repeats.alias("repetitive"),
        (F.col("n_symbols") * 100 > F.col("word_chars") * rules.max_symbols_percent).alias("symbols"),
        (F.col("n_dup_lines") > rules.max_dup_lines).alias("dup_lines"),
        (F.col("word_chars") > F.col("n_words") * rules.max_mean_word).alias("long_words"),
        (few | repeats).alias("base_failed"),
    )


RULES = ("few_words", "repetitive", "symbols", "dup_lines", "long_words")


def hosts(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each host: documents, failures of each rule, the shrunken rate of base failures and the verdict."""
    count = [F.count_if(F.col(r)).alias(f"n_{r}") for r in RULES]
    by_host = measured.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"), *count)
    rate = F.col("n_failed") / F.col("n_docs")
    # Method of moments: the variance between hosts is what is left after the binomial part.
    fit = by_host.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("inverse"))
    spread = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") - spread * F.col("inverse"), spread * 0.01)
    weight = F.when(spread > 0, F.greatest(F.lit(1.0), spread / between - 1)).otherwise(F.lit(1.0))
    prior = fit.select((F.col("m") * weight).alias("alpha"), ((1 - F.col("m")) * weight).alias("beta"))
    shrunk = (F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta"))
    return by_host.join(F.broadcast(prior)).withColumn("rate", shrunk).withColumn("rejected", F.col("rate") >= rules.reject_rate)  # prior: one row


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """A row for each document: measures, base_failed, host_rate, kept."""
    measured = materialize(measures(docs, id_col, text_col, host_col, rules), "measures")
    # written first, so that its size is known when the join is planned: sent to all if small, else both sides are dealt out
    judged = materialize(hosts(measured, rules).select(F.col("host").alias("judged"), F.col("rate").alias("host_rate"), F.col("rejected")), "hosts")
    joined = measured.join(judged, measured.host == judged.judged, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).drop("judged", "rejected")


def drop_failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, with all their columns; a null id is matched as such."""
    own, id_, host, text = plain(docs, id_col, host_col, text_col)
    # rows of one id stay or go by their own text and host
    mark = lambda i, h, t: F.xxhash64(i, h, text_of(t))
    rows = own.withColumns({"key": id_key(id_), "mark": mark(id_, host, text)})
    marked = rows.select(F.struct("key", "mark").alias("id"), host.alias("host"), text.alias("text"))
    stay = verdicts(marked, "id", "text", "host", rules).where("kept").select("id.key", "id.mark").distinct()
    return named_as(rows.join(stay, ["key", "mark"], "left_semi"), docs)
