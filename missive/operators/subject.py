"""What a message is about: subject statistics and the similarity join of subject signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions import text as T

# When two signatures name the same subject.
COSINE_FLOOR, CONTAINMENT_ACCEPT, COSINE_ACCEPT, DISTINCTIVE_SHARE = 0.34, 0.92, 0.62, 0.05


def with_subject(rows: DataFrame) -> DataFrame:
    """Add subject (a signature or null), subject_source and item_signature.

    Sources in order: the act frame's phrase, the title of a located item, a bare
    question, the question an item's message asked.
    """
    title = F.when(F.col("item_frame") != "unmatched", F.col("item_title"))
    phrases = {"item_signature": title, "_phrase": F.col("subject_phrase"), "_fallback": F.col("fallback_subject")}
    rows = rows.withColumns({f"{n}_t": T.sorted_tokens(p) for n, p in phrases.items()})
    rows = rows.withColumns({n: T.signature(p, F.col(f"{n}_t")) for n, p in phrases.items()}).drop(*(f"{n}_t" for n in phrases))
    asked = F.col("act") == "open_question"
    acted = ~F.col("act").isin("informational", "open_question")
    rows = rows.withColumns(
        {
            "subject": F.coalesce(F.when(acted, F.col("_phrase")), F.col("item_signature"), F.when(asked, F.col("_phrase")), F.col("_fallback")),
            "subject_source": F.when(acted & F.col("_phrase").isNotNull(), "act_frame").when(F.col("item_signature").isNotNull(), "l1_item_title").when((asked & F.col("_phrase").isNotNull()) | F.col("_fallback").isNotNull(), "open_question").otherwise("none"),
        }
    )
    # the located title is a variant only beside an act frame's own phrase
    return rows.withColumn("item_signature", F.when(F.col("subject_source") == "act_frame", F.col("item_signature"))).drop("_phrase", "_fallback")


def subject_idf(signatures: DataFrame, column: str = "subject") -> DataFrame:
    """(token, df, idf, n_subjects, distinctive_df) over the distinct token sets of a corpus."""
    sets = signatures.filter(F.col(column).isNotNull()).select(F.col(column)["tokens"].alias("tokens")).distinct()
    n = sets.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_subjects"))
    df = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_subjects") + 1) / (F.col("df") + 1)) + 1.0
    return df.crossJoin(F.broadcast(n)).select("token", "df", idf.alias("idf"), "n_subjects", F.greatest(F.lit(2), F.bround(F.col("n_subjects") * DISTINCTIVE_SHARE)).cast("long").alias("distinctive_df"))


def weighed(rows: DataFrame, idf: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, idf, df, distinctive_df): a row's tokens with their weights."""
    return rows.select(key, F.explode(tokens).alias("token")).join(idf, "token")


def accepted(shared: Column, mass_a: Column, mass_b: Column, n_shared: Column, any_specific: Column, lone_is_distinctive: Column) -> Column:
    """The match score, or null where the two don't name the same subject."""
    cosine, containment = shared / F.sqrt(mass_a * mass_b), shared / F.least(mass_a, mass_b)
    same = ((containment >= CONTAINMENT_ACCEPT) & (cosine >= COSINE_FLOOR)) | (cosine >= COSINE_ACCEPT)
    return F.when(any_specific & same & ((n_shared > 1) | lone_is_distinctive), F.round(0.5 * cosine + 0.5 * containment, 4))


def _ordered(rows: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """``weighed`` tokens with the row's ``mass`` and whether a token is ``leading``.

    A match shares at least COSINE_ACCEPT of the smaller mass. With a row's tokens in
    order of falling idf, those from which on less than that remains can't be the first
    that a match shares; the others lead.
    """
    rows = weighed(rows.withColumnRenamed("id", key), idf, key, F.col("tokens"))
    own = Window.partitionBy(key)
    left = F.sum("idf").over(own.orderBy("idf", F.desc("token")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"mass": F.sum("idf").over(own), "_left": left}).withColumn("leading", F.col("_left") >= COSINE_ACCEPT * F.col("mass") * (1 - 1e-9)).drop("_left")


def subject_pairs(left: DataFrame, right: DataFrame, idf: DataFrame) -> DataFrame:
    """(a, b, score, shared) of the signatures (id, tokens) that match.

    Candidates are joined on the leading tokens of the signature of smaller mass, which
    are its rarest; what all their tokens share is then summed for candidates alone, and
    a token alone only counts if it is rare.
    """
    a, b = _ordered(left, idf, "a"), _ordered(right, idf, "b")
    small_a = a.filter("leading").select("a", "token", F.col("mass").alias("mass_a")).join(b.select("b", "token", F.col("mass").alias("mass_b")), "token").filter("mass_a <= mass_b")
    small_b = a.select("a", "token", F.col("mass").alias("mass_a")).join(b.filter("leading").select("b", "token", F.col("mass").alias("mass_b")), "token").filter("mass_b <= mass_a")
    pairs = small_a.unionByName(small_b).groupBy("a", "b").agg(F.first("mass_a").alias("mass_a"), F.first("mass_b").alias("mass_b"))
    generic = F.col("token").isin(T.GENERIC_HEADS)
    both = pairs.join(a.select("a", "token", "idf", "df", "distinctive_df"), "a").join(b.select("b", "token"), ["b", "token"])
    both = both.groupBy("a", "b").agg(
        F.first("mass_a").alias("mass_a"), F.first("mass_b").alias("mass_b"), F.sum("idf").alias("shared_mass"), F.count("*").alias("n_shared"), F.bool_or(~generic).alias("specific"), F.bool_or(F.col("df") <= F.col("distinctive_df")).alias("rare"), F.sort_array(F.collect_list("token")).alias("shared")
    )
    score = accepted(F.col("shared_mass"), F.col("mass_a"), F.col("mass_b"), F.col("n_shared"), F.col("specific"), F.col("rare"))
    return both.select("a", "b", score.alias("score"), "shared").filter("score is not null")


def best_match(pairs: DataFrame) -> DataFrame:
    """The best partner b of each a; of equal scores the first in order of b."""
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
