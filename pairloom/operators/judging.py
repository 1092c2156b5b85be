"""Prompts for pairwise judges, and scoring of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K

# Our own wording; only the structure (intro, numbered pairs, task, marker) is given.
INTRO = "Below are image pairs one person has compared. For every pair you see which image they liked more."
TASK = "Now look at the new pair and say which of its two images this person would like more."
PROFILE_INTRO = "Below is a description of one person's taste and a pair of images."
REASONING = (
    "First describe both images of every pair, then note how they differ in style and quality, "
    "then sum up the person's taste in a few words."
)
ANSWER_FORMAT = f"End your answer with: {C.ANSWER_MARKER}[1 or 2]"
SYSTEM_TEXT = "You compare images and predict the taste of a person from earlier choices."
IMAGE_SLOT = "<image>"


def parse_answer(text: Column, marker: str = C.ANSWER_MARKER) -> Column:
    """Integer after the last marker, or the whole text as an integer where there is no marker; null if it is none."""
    tail = F.substring_index(text, marker, -1)
    return K.strip(tail).try_cast("int")


def parse_answer_loose(text: Column) -> Column:
    """1 if the text holds a 1, else 2 if it holds a 2, else null."""
    return F.when(F.contains(text, F.lit("1")), 1).when(F.contains(text, F.lit("2")), 2).cast("int")


def score_pair(first: Column, second: Column, failed: Column | None = None, fold_unparsed: bool = False) -> Column:
    """Score of the two parsed answers, where 1 then 2 names the preferred image both times.

    `failed` marks rows whose call did not return; `fold_unparsed` counts
    unreadable answers as failed calls.
    """
    unread = C.SCORE_FAILED if fold_unparsed else C.SCORE_UNPARSED
    score = (
        F.when(first.isNull() | second.isNull(), unread)
        .when((first == 1) & (second == 2), C.SCORE_CORRECT)
        .when((first == 2) & (second == 1), C.SCORE_WRONG)
        .otherwise(C.SCORE_INCONSISTENT)
    )
    return (score if failed is None else F.when(failed, C.SCORE_FAILED).otherwise(score)).cast("int")


def shows_preferred_first(seed: int, *parts: Column) -> Column:
    """Fair, repeatable coin for the side on which the preferred image is shown."""
    return F.substring(K.seeded_hash(seed, *parts), 1, 1) >= "8"


def few_shot_prompt(
    pairs: Column,
    row_key: Column,
    held_out: bool = False,
    with_caption: bool = True,
    reasoning: bool = False,
    randomise: bool = False,
    seed: int = 0,
) -> Column:
    """Prompt text of a group of pairs in order.

    With `held_out` the last pair is the question and not an example.  With
    `randomise` each example's preferred image is shown first or second by a
    seeded coin and labelled 1 or 2.
    """
    examples = F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))) if held_out else pairs

    def example(p: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        lines = [F.concat(F.lit("Pair "), number, F.lit(":"))]
        if with_caption:
            lines.append(F.concat(F.lit("Caption: "), p["caption"]))
        if randomise:
            label = F.when(shows_preferred_first(seed, row_key, i), "1").otherwise("2")
            lines.append(F.lit(f"Image 1: {IMAGE_SLOT}\nImage 2: {IMAGE_SLOT}"))
            lines.append(F.concat(F.lit(C.ANSWER_MARKER), label))
        else:
            lines.append(F.lit(f"Preferred: {IMAGE_SLOT}\nDispreferred: {IMAGE_SLOT}"))
        return F.array_join(F.array(*lines), "\n")

    parts = [F.array(F.lit(INTRO)), F.transform(examples, example)]
    if reasoning:
        parts.append(F.array(F.lit(REASONING)))
    if held_out:
        parts.append(F.array(F.lit(f"{TASK}\nImage 1: {IMAGE_SLOT}\nImage 2: {IMAGE_SLOT}\n{ANSWER_FORMAT}")))
    return F.array_join(F.concat(*parts), "\n\n")


def image_order(pairs: Column, row_key: Column, swap_last: bool, randomise: bool = False, seed: int = 0) -> Column:
    """Image uids in the order a prompt shows them; the last pair may be swapped."""
    last = F.size(pairs) - 1

    def sides(p: Column, i: Column) -> Column:
        straight = F.array(p["preferred_uid"], p["dispreferred_uid"])
        turned = F.array(p["dispreferred_uid"], p["preferred_uid"])
        example = F.when(shows_preferred_first(seed, row_key, i), straight).otherwise(turned) if randomise else straight
        return F.when(i == last, turned if swap_last else straight).otherwise(example)

    return F.flatten(F.transform(pairs, sides))


def _part(kind: str, text: Column | None = None, uid: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        (none if text is None else text).alias("text"),
        (none if uid is None else uid).alias("image_uid"),
    )


def _messages(content: Column) -> Column:
    system = F.struct(F.lit("system").alias("role"), F.array(_part("text", F.lit(SYSTEM_TEXT))).alias("content"))
    return F.array(system, F.struct(F.lit("user").alias("role"), content.alias("content")))


def judge_messages(
    pairs: Column,
    row_key: Column,
    swap_last: bool,
    with_caption: bool = True,
    reasoning: bool = False,
    seed: int = 0,
) -> Column:
    """Role/content messages: labelled examples, the task, then the open pair in one of both orders."""
    n = F.size(pairs)

    def caption(p: Column) -> list[Column]:
        return [_part("text", F.concat(F.lit("Caption: "), p["caption"]))] if with_caption else []

    def example(p: Column, i: Column) -> Column:
        straight = shows_preferred_first(seed, row_key, i)
        left = F.when(straight, p["preferred_uid"]).otherwise(p["dispreferred_uid"])
        right = F.when(straight, p["dispreferred_uid"]).otherwise(p["preferred_uid"])
        label = F.concat(F.lit(C.ANSWER_MARKER), F.when(straight, "1").otherwise("2"))
        return F.array(
            _part("text", F.concat(F.lit("Pair "), (i + 1).cast("string"), F.lit(":"))),
            *caption(p),
            _part("image", uid=left),
            _part("image", uid=right),
            _part("text", label),
        )

    last = F.element_at(pairs, -1)
    sides = ("dispreferred_uid", "preferred_uid") if swap_last else ("preferred_uid", "dispreferred_uid")
    task = f"{REASONING}\n{TASK}\n{ANSWER_FORMAT}" if reasoning else f"{TASK}\n{ANSWER_FORMAT}"
    content = F.concat(
        F.array(_part("text", F.lit(INTRO))),
        F.flatten(F.transform(F.slice(pairs, 1, F.greatest(n - 1, F.lit(0))), example)),
        F.array(
            _part("text", F.lit(task)),
            _part("text", F.concat(F.lit("Pair "), n.cast("string"), F.lit(":"))),
            *caption(last),
            *[_part("image", uid=last[s]) for s in sides],
        ),
    )
    return _messages(content)


def profile_messages(description: Column, preferred: Column, dispreferred: Column, swap: bool, reasoning: bool = False) -> Column:
    """Messages that ask for a choice from a written user description."""
    task = f"{REASONING}\n{ANSWER_FORMAT}" if reasoning else ANSWER_FORMAT
    images = (dispreferred, preferred) if swap else (preferred, dispreferred)
    return _messages(
        F.array(
            _part("text", F.lit(PROFILE_INTRO)),
            _part("text", description),
            _part("text", F.lit(task)),
            *[_part("image", uid=u) for u in images],
        )
    )


def messages_valid(messages: Column) -> Column:
    """Every part is text or image, and carries exactly what its type says."""
    def part_ok(part: Column) -> Column:
        has_text, has_image = part["text"].isNotNull(), part["image_uid"].isNotNull()
        return (
            F.when(part["type"] == "text", has_text & ~has_image)
            .when(part["type"] == "image", has_image & ~has_text)
            .otherwise(F.lit(False))
        )

    return F.forall(messages, lambda m: F.forall(m["content"], part_ok))


def score_answers(df: DataFrame, first: str, second: str, failed: Column | None = None, fold_unparsed: bool = False) -> DataFrame:
    """Adds the parsed choices and the score."""
    return (
        df.withColumn("choice_first", parse_answer(F.col(first)))
        .withColumn("choice_second", parse_answer(F.col(second)))
        .withColumn("score", score_pair(F.col("choice_first"), F.col("choice_second"), failed, fold_unparsed))
    )


def score_distribution(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows per score."""
    return scored.groupBy(*(keys or []), "score").agg(F.count(F.lit(1)).alias("n_rows"))


def win_rate(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Wins over decided rows, and the share of readable rows that were consistent."""
    wins, losses = (F.count_if(F.col("score") == s) for s in (C.SCORE_CORRECT, C.SCORE_WRONG))
    readable = F.count_if(F.col("score") >= C.SCORE_INCONSISTENT)
    return scored.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        wins.alias("wins"),
        losses.alias("losses"),
        (wins / F.nullif(wins + losses, F.lit(0))).alias("win_rate"),
        ((wins + losses) / F.nullif(readable, F.lit(0))).alias("consistent_share"),
    )
