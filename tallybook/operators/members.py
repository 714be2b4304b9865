"""Member keys: generation from names and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import key_from_name, suffixed_key


def shared_keys(members: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Keys held by more than one member, with the number of holders.

    Counted with a partial aggregate: a key shared by a third of the members is no hot task.
    """
    key = F.lower("user_key") if ignore_case else F.col("user_key")
    return members.groupBy(key.alias("_key")).agg(F.count("*").alias("holders")).where("holders > 1")


def duplicate_user_keys(members: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Members whose key equals another member's."""
    key = F.lower("user_key") if ignore_case else F.col("user_key")
    keyed = members.select("id", "user_key", key.alias("_key"))
    return keyed.join(shared_keys(members, ignore_case), "_key").select("id", "user_key", "holders")


def user_keys_generated(members: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Keys from names; every member of a group with equal keys gets a suffix from the id.

    A key that is empty but unique stays empty.
    """
    named = members.select("id", key_from_name("role", "name").alias("user_key"))
    key = F.lower("user_key") if ignore_case else F.col("user_key")
    marked = named.withColumn("_key", key).join(shared_keys(named, ignore_case), "_key", "left")
    final = F.when(F.col("holders").isNotNull(), suffixed_key("user_key", "id")).otherwise(F.col("user_key"))
    return marked.select("id", final.alias("user_key"))
