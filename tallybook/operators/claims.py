"""Who may take a key when: claims of unique keys, judged as if they came one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import stage

# How a member's hold on a key over a stretch of time follows from the claims not yet judged.
SURE, IF, UNLESS, UNCLEAR = KINDS = "sure", "if", "unless", "unclear"
ENDLESS = 2**63 - 1
GUESSES = 2  # in a row, before a round of judging


def settle(stored: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims (id, _key, _at) with a flag ``_ok``: did nobody else hold the key when the claim was made?

    ``stored`` (id, _key) are the holders before the first claim. A valid claim takes its key and gives up the one
    that the member held. Claims are ordered by ``_at``, ties by id and key; repeated claims count once.

    A round of guessing walks along each key's claims: a key is taken by the first claim that finds it free, until its member
    takes another one by the guesses of the round before. A guess depends on earlier claims only, so up to the first claim
    whose guess changed all guesses are outcomes: that claim and all before it are judged, and without a change all are.

    A round of judging derives from what is judged so far, for every open claim, who may hold its key. If somebody surely
    does, it fails; if nobody can, it holds; if a single hold is in doubt, and that by a single claim, the claim has the same
    outcome as that claim or the opposite one. Such links are followed by pointer doubling, so a chain of n of
    them takes log2(n) steps. What depends on several open claims waits for the next round.

    Guessing ends early where keys rarely change hands, however often they are claimed, and links end long chains of keys
    that are handed on. The earliest open claim is judged in either round, so the rounds end. Keys and members are sorted
    rows, which spill; no list of holders is built. Failed claims leave the rounds as soon as no link leads to them.
    """
    numbered = claims.select("id", "_key", "_at").distinct().orderBy("_at", "id", "_key").withColumn("_n", F.monotonically_increasing_id())
    numbered = stage(numbered, "claims")  # the numbers rise in the order of the claims
    state = numbered.select(
        "id", "_key", "_n", F.lit(None).cast("boolean").alias("_ok"), F.lit(None).cast("long").alias("_to"), F.lit(False).alias("_not"),
        F.lit(False).alias("_guess"),
    )
    start = stored.select("id", "_key").distinct()
    waiting, guesses, still_open = True, 0, F.col("_ok").isNull()
    while True:
        links = state.where(still_open & F.col("_to").isNotNull())
        led_to = state.where("not _ok").join(links.select(F.col("_to").alias("_n")).distinct(), "_n", "left_semi")
        guessing = waiting and guesses < GUESSES
        if guessing:
            rows = _guessed(state, start)
        else:
            rows = state.where("_ok").withColumns({"_moved": F.lit(False), "_changed": F.lit(False)}).unionByName(_followed(links, state))
            rows = rows.unionByName(_judged(state, start)) if waiting else rows
        state = stage(rows.unionByName(led_to.withColumns({"_moved": F.lit(False), "_changed": F.lit(False)})), "claims")
        left, moving, last, first = state.agg(
            F.count_if(still_open), F.count_if(still_open & F.col("_moved")), F.max(F.when(still_open, F.col("_n"))),
            F.min(F.when(F.col("_changed"), F.col("_n"))),
        ).first()
        state = state.drop("_moved", "_changed")
        if guessing:
            guesses += 1
            proven = still_open if first is None else still_open & (F.col("_n") <= first)
            state = state.withColumn("_ok", F.when(proven, F.col("_guess")).otherwise(F.col("_ok")))
        else:
            # while all open claims get nearer to their ends by links, there is nobody to ask
            guesses, waiting = 0, moving < left
        if not left or guessing and (first is None or last <= first):
            valid = state.where("_ok").select("_n", "_ok")
            return numbered.join(valid, "_n", "left").select("id", "_key", "_at", F.coalesce("_ok", F.lit(False)).alias("_ok"))


def _guessed(state: DataFrame, start: DataFrame) -> DataFrame:
    """The open and valid claims with new guesses; ``_changed`` says which differ from those before."""
    rows = state.where("_ok is null or _ok")
    rows = start.unionByName(rows, allowMissingColumns=True).withColumn("_taken", F.coalesce("_ok", "_guess", F.lit(True)))
    later = Window.partitionBy("id").orderBy(F.col("_n").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    until = F.last(F.when(F.col("_taken"), F.col("_n")), ignorenulls=True).over(later)
    rows = rows.select(*state.columns, F.coalesce(until, F.lit(ENDLESS)).alias("_until"), F.lit(False).alias("_moved"), F.lit(False).alias("_changed"))
    walked = rows.repartition("_key").sortWithinPartitions("_key", F.col("_n").asc_nulls_first()).mapInArrow(_walk(), rows.schema)
    return walked.where("_n is not null").drop("_until")


def _walk() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Claims in order, key by key, against the member who holds the key; stored rows, without a number, come first.

    Several members may hold a key from the start. Of these the two who keep it longest say whether somebody else has it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, holder, until, second = object(), None, -1, -1
        for batch in batches:
            guesses, changed = [], []
            columns = (batch[name].to_pylist() for name in ("_key", "id", "_n", "_until", "_ok", "_guess"))
            for k, member, number, end, ok, before in zip(*columns):
                if k != key:
                    key, holder, until, second = k, None, -1, -1
                if number is None:
                    guess = before
                    if end > until:
                        holder, until, second = member, end, until
                    else:
                        second = max(second, end)
                else:
                    guess = ok if ok is not None else (second if holder == member else until) < number
                    if guess:
                        holder, until, second = member, end, -1
                guesses.append(guess)
                changed.append(number is not None and ok is None and guess != before)
            new = {"_guess": pa.array(guesses, pa.bool_()), "_changed": pa.array(changed, pa.bool_())}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(name, batch[name]) for name in names], names=names)

    return walk


def _followed(links: DataFrame, state: DataFrame) -> DataFrame:
    """Links replaced by the outcome of the claim they lead to, or by that one's own link; ``_moved`` says which are on their way."""
    ends = state.select(
        F.col("_n").alias("_to"), F.col("_ok").alias("_end_ok"), F.col("_to").alias("_end_to"), F.col("_not").alias("_end_not"),
    )
    further = F.col("_end_ok").isNull() & F.col("_end_to").isNotNull()
    return links.join(ends, "_to").select(
        "id", "_key", "_n", (F.col("_end_ok") != F.col("_not")).alias("_ok"), F.when(further, F.col("_end_to")).otherwise(F.col("_to")).alias("_to"),
        F.when(further, F.col("_not") != F.col("_end_not")).otherwise(F.col("_not")).alias("_not"), "_guess",
        further.alias("_moved"), F.lit(False).alias("_changed"),
    )


def _steps(state: DataFrame, start: DataFrame) -> DataFrame:
    """Steps (id, _key, _n) up or down in the number of a member's holds of each kind on a key, from the claim numbered ``_n`` on.

    A claim's key is the member's until its next claim that is valid. With one open claim in between, the hold depends on
    that claim, ``_by``; from the second one on it is unclear, up to the next valid claim. The step at an open claim that
    follows no link is also the question, ``_asked``, who holds its key.
    """
    rows = start.select(
        "id", "_key", F.lit(None).cast("long").alias("_n"), F.lit(True).alias("_ok"), F.lit(False).alias("_asked"), F.lit(None).cast("boolean").alias("_guess")
    )
    asked = F.col("_ok").isNull() & F.col("_to").isNull()
    rows = rows.unionByName(state.where("_ok is null or _ok").select("id", "_key", "_n", "_ok", asked.alias("_asked"), "_guess"))
    back = Window.partitionBy("id").orderBy(F.col("_n").desc_nulls_last())
    later = back.rowsBetween(Window.unboundedPreceding, -1)

    def next_of(column: str, steps: int) -> Column:
        return F.lag(column, steps).over(back)

    rows = rows.select(
        "id", "_key", "_n", "_asked", "_guess", F.coalesce("_ok", F.lit(False)).alias("_valid"),
        next_of("_n", 1).alias("_n1"), next_of("_ok", 1).alias("_ok1"), next_of("_n", 2).alias("_n2"), next_of("_ok", 2).alias("_ok2"),
        F.last(F.when(F.col("_ok"), F.col("_n")), ignorenulls=True).over(later).alias("_next_valid"),
    )
    valid, doubt = F.col("_valid"), F.col("_n1").isNotNull() & F.col("_ok1").isNull()
    second = F.col("_n2").isNotNull() & F.col("_ok2").isNull()

    def step(at: str, by: Column | None = None, asked: Column | None = None, **kinds: Column | int) -> Column:
        changes = (F.lit(kinds.get(f"{kind}_", 0)).cast("int").alias(kind) for kind in KINDS)
        by = F.lit(None) if by is None else by
        return F.struct(F.col(at).alias("_n"), by.cast("long").alias("_by"), (F.lit(False) if asked is None else asked).alias("_asked"), *changes)

    def down(condition: Column) -> Column:
        return -condition.cast("int")

    steps = F.array_compact(F.array(
        step("_n", F.when(~valid, F.col("_n")), F.col("_asked"), sure_=valid, if_=~valid),
        F.when(F.col("_n1").isNotNull(), step(
            "_n1", F.when(~valid, F.col("_n")).when(doubt, F.col("_n1")), sure_=down(valid), if_=down(~valid), unless_=valid & doubt, unclear_=~valid & doubt,
        )),
        F.when(valid & doubt & F.col("_n2").isNotNull(), step("_n2", F.col("_n1"), unless_=-1, unclear_=second)),
        F.when(doubt & (~valid | second) & F.col("_next_valid").isNotNull(), step("_next_valid", unclear_=-1)),
    ))
    return rows.select("id", "_key", "_guess", F.inline(steps))


def _judged(state: DataFrame, start: DataFrame) -> DataFrame:
    """The open claims that follow no link, with what follows for them from the holds of other members at their time."""
    asked = state.where("_ok is null and _to is null")
    steps = _steps(state, start).join(asked.select("_key").distinct(), "_key", "left_semi")
    # other steps at a claim's own number are its own member's; the claim comes before them in both windows
    earlier = [F.col("_n").asc_nulls_first(), F.col("_asked").desc()]
    everyone = Window.partitionBy("_key").orderBy(*earlier).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("_key", "id").orderBy(*earlier).rowsBetween(Window.unboundedPreceding, -1)

    def by_others(kind: str) -> Column:
        return F.coalesce(F.sum(kind).over(everyone), F.lit(0)) - F.coalesce(F.sum(kind).over(own), F.lit(0))

    # a hold brings its claim's number in and takes it out again; what is left of a single one is its number
    number = F.coalesce("_by", F.lit(0))
    one = F.coalesce(F.bit_xor(number).over(everyone), F.lit(0)).bitwiseXOR(F.coalesce(F.bit_xor(number).over(own), F.lit(0)))
    seen = steps.select("id", "_key", "_n", "_asked", "_guess", *(by_others(kind).alias(kind) for kind in KINDS), one.alias("_one")).where("_asked")
    single = (F.col(UNCLEAR) == 0) & (F.col(IF) + F.col(UNLESS) == 1)
    linked = (F.col(SURE) == 0) & single
    ok = F.when(F.col(SURE) > 0, False).when((F.col(UNCLEAR) == 0) & (F.col(IF) + F.col(UNLESS) == 0), True)
    return seen.select(
        "id", "_key", "_n", ok.alias("_ok"), F.when(linked, F.col("_one")).alias("_to"), (linked & (F.col(IF) == 1)).alias("_not"),
        "_guess", linked.alias("_moved"), F.lit(False).alias("_changed"),
    )
