"""Suggestion board, news feed, and who has unread news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.prefix import asc, parts, running_totals

NEVER = "timestamp_ntz'1970-01-01 00:00:00'"
THREAD_PART = 1000


def _counts(rows: DataFrame, item: str, name: str) -> DataFrame:
    return rows.groupBy(item).agg(F.count("*").alias(name))


def _authors(t) -> DataFrame:
    return t.users.select(F.col("id").alias("created_by"), F.col("name").alias("author_name"))


def _author_names(t, posts: DataFrame) -> DataFrame:
    """(id, author_name): found on narrow rows, so that texts are shuffled by post id only."""
    return posts.select("id", "created_by").join(_authors(t), "created_by").select("id", "author_name")


def _none() -> Column:
    return F.lit(0).cast("bigint")


def suggestion_board(t, viewer=None, ordered: bool = True) -> DataFrame:
    """Suggestions with author, votes and the viewer's own vote; open first, then most votes, newest."""
    votes = _counts(t.suggestion_votes, "suggestion_id", "upvotes")
    own = t.suggestion_votes.where(F.col("user_id") == F.lit(viewer)).select(
        "suggestion_id", F.lit(True).alias("voted")
    )
    board = (
        t.suggestions.select("id", "title", "description", "status", "created_at")
        .join(_author_names(t, t.suggestions), "id")
        .join(votes.join(own, "suggestion_id", "left"), F.col("id") == F.col("suggestion_id"), "left")
        .select(
            "id", "title", "description", "status", F.col("author_name").alias("created_by_name"), "created_at",
            F.coalesce("upvotes", _none()).alias("upvotes"), F.coalesce("voted", F.lit(False)).alias("user_voted"),
        )
    )
    rank = F.when(F.col("status") == "open", 0).when(F.col("status") == "added", 1).otherwise(2)
    return board.orderBy(rank, F.col("upvotes").desc(), F.col("created_at").desc(), "id") if ordered else board


def suggestions_open(t, viewer=None, ordered: bool = True) -> DataFrame:
    return suggestion_board(t, viewer, ordered).where("status = 'open'")


def suggestions_decided(t, viewer=None, ordered: bool = True) -> DataFrame:
    return suggestion_board(t, viewer, ordered).where("status <> 'open'")


def user_voted(t) -> DataFrame:
    """Every (suggestion, member) pair whose own-vote flag is true; all other pairs are false."""
    found = t.suggestions.select(F.col("id").alias("suggestion_id"))
    votes = t.suggestion_votes.select("suggestion_id", "user_id")
    return votes.join(found, "suggestion_id", "left_semi").withColumn("user_voted", F.lit(True))


def user_liked(t) -> DataFrame:
    """Every (post, member) pair whose own-like flag is true; all other pairs are false."""
    found = t.news.select(F.col("id").alias("news_id"))
    return t.news_likes.select("news_id", "user_id").join(found, "news_id", "left_semi").withColumn(
        "user_liked", F.lit(True)
    )


def vote_counts(t) -> DataFrame:
    items = t.suggestions.select(F.col("id").alias("suggestion_id"))
    counted = items.join(_counts(t.suggestion_votes, "suggestion_id", "votes"), "suggestion_id", "left")
    return counted.select("suggestion_id", F.coalesce("votes", _none()).alias("votes"))


def like_counts(t) -> DataFrame:
    items = t.news.select(F.col("id").alias("news_id"))
    counted = items.join(_counts(t.news_likes, "news_id", "likes"), "news_id", "left")
    return counted.select("news_id", F.coalesce("likes", _none()).alias("likes"))


def news_feed(t, viewer=None, ordered: bool = True) -> DataFrame:
    """News newest first with author, like and comment counts and the viewer's own like.

    Likes and comments are counted per post before they meet the posts. The comments themselves are
    in ``comment_threads``.
    """
    likes = t.news_likes.groupBy("news_id").agg(
        F.count("*").alias("likes"), F.max(F.col("user_id") == F.lit(viewer)).alias("liked")
    )
    comments = _counts(t.news_comments, "news_id", "comments")
    figures = likes.join(comments, "news_id", "full_outer")
    feed = (
        t.news.select("id", "title", "body", "image_data_url", "created_at")
        .join(_author_names(t, t.news), "id")
        .join(figures, F.col("id") == F.col("news_id"), "left")
        .select(
            "id", "title", "body", "image_data_url", "created_at", "author_name",
            F.coalesce("likes", _none()).alias("likes_count"),
            F.coalesce("comments", _none()).alias("comments_count"),
            F.coalesce("liked", F.lit(False)).alias("user_liked"),
        )
    )
    return feed.orderBy(F.col("created_at").desc(), "id") if ordered else feed


def comment_threads(t, part_size: int = THREAD_PART) -> DataFrame:
    """Comments of every post with their authors, oldest first, as nested parts of bounded size."""
    rows = t.news_comments.select("id", "news_id", "user_id", "body", "created_at")
    placed = running_totals(rows, ["news_id"], [asc("created_at"), asc("id")], row_no="position")
    authors = _authors(t).withColumnRenamed("created_by", "user_id")
    named = placed.join(authors, "user_id")
    return parts(named, ["news_id"], "position", ["id", "user_id", "author_name", "body", "created_at"], part_size)


def newest_authors(news: DataFrame) -> DataFrame:
    """Latest post time of the two authors who posted last: at most two rows."""
    latest = news.groupBy("created_by").agg(F.max("created_at").alias("last_post"))
    return latest.orderBy(F.col("last_post").desc(), "created_by").limit(2)


def news_unread(t) -> DataFrame:
    """Per member: is there news by somebody else after the read mark?

    Only the newest post by another author matters, and that is by one of the two authors who
    posted last. Those two rows come in as a scalar subquery, so members never meet all posts.
    """
    return unread_flags(t.users.select(F.col("id").alias("user_id")), t.news_reads, newest_authors(t.news))


def unread_flags(members: DataFrame, reads: DataFrame, newest: DataFrame) -> DataFrame:
    """Unread flag per member from read marks and the newest authors."""
    pair = newest.agg(F.collect_list(F.struct("created_by", "last_post")).alias("pair")).scalar()
    marked = members.join(reads.select("user_id", "last_seen_at"), "user_id", "left").withColumn("_pair", pair)
    seen = F.coalesce("last_seen_at", F.expr(NEVER))
    unread = F.exists("_pair", lambda post: (post.created_by != F.col("user_id")) & (post.last_post > seen))
    return marked.select("user_id", unread.alias("unread"))
