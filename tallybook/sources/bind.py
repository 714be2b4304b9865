"""Binding of the thirteen tables onto the parquet test tables.

Every table is bound whole: no id ranges, no sampling. Money columns of the files have at most two
decimals, so the casts to decimal(10,2) are exact. Timestamps stay ``timestamp_ntz``.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.money import booked_total
from tallybook.operators.changes import clean_setting_changes, latest_wins, toggle_state

# Declared schemas of the parquet files, so that no job has to read footers for them.
FILES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

AS_OF = dt.date(2000, 6, 15)
OPENING_DAY = "timestamp_ntz'1995-01-01 00:00:00'"
K = "cast(get_json_object(props, '$.k') as bigint)"
LAUNCH = "timestamp_ntz'2024-01-01 00:00:00'"


def post_time(number: str) -> str:
    """Posts are half an hour apart."""
    return f"{LAUNCH} + make_dt_interval(cast({number} div 48 as int), 0, cast({number} % 48 * 30 as int))"


class BoundTables:
    """The tables as lazily built DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(FILES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same files as a stream."""
        reader = self.spark.readStream.schema(FILES[name]).option("maxFilesPerTrigger", 64)
        return reader.parquet(f"{self.sf_dir}/{name}*.parquet")

    def events(self, kind: str | None = None, stream: bool = False) -> DataFrame:
        """Events with the integer ``k`` of their properties."""
        source = self.stream("events") if stream else self.raw("events")
        events = source.selectExpr("*", f"{K} as k")
        return events if kind is None else events.where(f"event_type = '{kind}'")

    def member_number(self, number: str) -> Column:
        """Spread a number over the member ids, which run from 0 to count − 1."""
        return F.pmod(F.expr(number), self._members)

    @cached_property
    def _members(self) -> Column:
        return self.raw("customer").agg(F.count("*")).scalar()

    # ledger -----------------------------------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        """Customers, plus suppliers as members who never buy anything (ids below 0)."""
        customers = self.raw("customer").selectExpr(
            "c_custkey as id", "lower(c_name) as user_key", "c_name as name",
            "if(c_custkey % 100 = 0, 'admin', 'user') as role", "c_mktsegment <> 'AUTOMOBILE' as active",
            f"{OPENING_DAY} as created_at", f"{OPENING_DAY} as updated_at",
        )
        suppliers = self.raw("supplier").selectExpr(
            "-s_suppkey - 1 as id", "lower(s_name) as user_key", "s_name as name",
            "if(s_nationkey % 5 = 0, 'admin', 'user') as role", "s_acctbal > 0 as active",
            f"{OPENING_DAY} as created_at", f"{OPENING_DAY} as updated_at",
        )
        return customers.unionAll(suppliers)

    @cached_property
    def named_users(self) -> DataFrame:
        """Members named after parts where there is one, with text ids: many names repeat."""
        names = self.raw("part").selectExpr("p_partkey as id", "p_name as name")
        named = self.users.withColumnRenamed("name", "_name").join(names, "id", "left").withColumn("name", F.coalesce("name", "_name"))
        return named.selectExpr("md5(cast(id as string)) as id", "user_key", "name", "role", "active")

    @cached_property
    def categories(self) -> DataFrame:
        """Brands, plus one category without products."""
        brands = self.raw("part").selectExpr("p_brand as id").distinct().selectExpr(
            "id", "id as title", "concat('icon:', id) as icon_data_url", "id <> 'Brand#3' as active"
        )
        empty = self.spark.sql(
            "select * from values ('cat-empty', 'Allgemein', '', true) as t (id, title, icon_data_url, active)"
        )
        return brands.unionAll(empty).selectExpr("*", f"{OPENING_DAY} as created_at", f"{OPENING_DAY} as updated_at")

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as id", "p_name as name", "'' as description", "cast(p_retailprice as decimal(10,2)) as price",
            "if(p_size % 10 <> 0, p_brand, null) as category_id", "concat('icon:', p_partkey) as icon_data_url",
            "p_type = 'PROMO' as excluded_from_revenue", "p_size % 7 <> 0 as active",
            f"{OPENING_DAY} as created_at", f"{OPENING_DAY} as updated_at",
        )

    @cached_property
    def entries(self) -> DataFrame:
        """Line items; the price at booking time is two cents per whole unit of the extended price."""
        orders = self.raw("orders").selectExpr("o_orderkey as l_orderkey", "o_custkey as user_id")
        # only plain columns go through the join: ids and times of deletion are long and follow from them
        lines = self.raw("lineitem").selectExpr(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_quantity as int) as quantity",
            "cast(floor(l_extendedprice) * 0.02BD as decimal(10,2)) as unit_price", "l_linestatus = 'F' as paid",
            "l_returnflag = 'R' as returned", "l_shipdate", "l_linestatus", "l_tax",
        )
        return lines.join(orders, "l_orderkey").selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, unix_date(cast(l_shipdate as date))) as id",
            "l_partkey as product_id", "quantity", "unit_price", "paid", "cast(null as timestamp_ntz) as paid_at",
            "if(returned, l_shipdate + interval 7 days, null) as deleted_at",
            "cast(null as bigint) as deleted_by", "if(returned, 'Fehlbuchung', null) as deleted_reason",
            "l_shipdate as created_at", "l_linestatus as line_status", "l_tax as tax", "user_id",
        ).withColumn("total", booked_total())

    @cached_property
    def payments(self) -> DataFrame:
        return self.raw("orders").where("o_orderstatus = 'F'").selectExpr(
            "cast(o_orderkey as string) as id", "o_custkey as user_id", "cast(o_totalprice as decimal(10,2)) as amount",
            "o_orderpriority as note", "cast(null as bigint) as created_by", "o_orderdate as created_at",
        )

    @cached_property
    def adjustments(self) -> DataFrame:
        return self.raw("customer").where("c_acctbal <> 0").selectExpr(
            "cast(c_custkey as string) as id", "c_custkey as user_id", "cast(c_acctbal as decimal(10,2)) as amount",
            "c_mktsegment as note", "cast(null as bigint) as created_by", f"{OPENING_DAY} as created_at",
        )

    # community --------------------------------------------------------------------------------

    @cached_property
    def news(self) -> DataFrame:
        posted = post_time("doc_id")
        posts = self.raw("documents").selectExpr(
            "doc_id as id", "concat_ws(' ', lang, source) as title", "text as body", "'' as image_data_url",
            f"{posted} as created_at", f"{posted} as updated_at",
        )
        return posts.withColumn("created_by", self.member_number("id"))

    @cached_property
    def suggestions(self) -> DataFrame:
        posted = post_time("page_id")
        posts = self.raw("pages").selectExpr(
            "page_id as id", "url as title", "html as description",
            "element_at(array('open', 'added', 'rejected'), cast(page_id % 3 + 1 as int)) as status",
            f"{posted} as created_at", f"{posted} as updated_at",
        )
        return posts.withColumn("created_by", self.member_number("id"))

    @cached_property
    def like_toggles(self) -> DataFrame:
        return self.events("click").selectExpr("k as news_id", "user_id", "ts as created_at")

    @cached_property
    def vote_toggles(self) -> DataFrame:
        return self.events("signup").selectExpr("k as suggestion_id", "user_id", "ts as created_at")

    @cached_property
    def news_likes(self) -> DataFrame:
        return toggle_state(self.like_toggles, "news_id", self.news).state

    @cached_property
    def suggestion_votes(self) -> DataFrame:
        return toggle_state(self.vote_toggles, "suggestion_id", self.suggestions).state

    @cached_property
    def read_marks(self) -> DataFrame:
        return self.events("view").selectExpr("user_id", "ts as last_seen_at")

    @cached_property
    def news_reads(self) -> DataFrame:
        return latest_wins(self.read_marks, ["user_id"], ["last_seen_at"])

    @cached_property
    def news_comments(self) -> DataFrame:
        comments = self.raw("conversations").selectExpr(
            "concat_ws('-', conv_id, turn) as id", "conv_id as news_id", "text as body", "turn",
            f"{post_time('conv_id')} + make_dt_interval(0, 0, cast(turn + 1 as int)) as created_at",
        )
        return comments.withColumn("user_id", self.member_number("news_id + turn"))

    # change batches ---------------------------------------------------------------------------

    @cached_property
    def setting_changes(self) -> DataFrame:
        """Every event sets the pay handle, in one of five raw forms."""
        return self.events().selectExpr(
            "event_id", "'paypal_me' as key",
            "element_at(array(concat(' https://www.PayPal.me/shop.', user_id), concat('paypal.me/shop.', user_id, '/25'),"
            " concat('@shop.', user_id), 'ab', concat('shop.', user_id, '?locale=de')), cast(k % 5 + 1 as int)) as value",
            "user_id as updated_by", "ts as updated_at",
        )

    @cached_property
    def settings(self) -> DataFrame:
        accepted = clean_setting_changes(self.setting_changes).accepted
        return latest_wins(accepted, ["key"], ["updated_at", "event_id"]).drop("event_id")

    @cached_property
    def booking_requests(self) -> DataFrame:
        return self.bookings(self.events("purchase"))

    def bookings(self, events: DataFrame) -> DataFrame:
        return events.selectExpr(
            "cast(event_id as string) as id", "user_id", "k * 3 as product_id",
            "cast(floor(value / 50) as int) as quantity", "ts as created_at",
        )

    @cached_property
    def user_changes(self) -> DataFrame:
        """Half of the changes name an existing member, half a new one; keys collide often."""
        return self.events("signup").selectExpr(
            "if(k % 2 = 0, user_id, -event_id) as id", "concat(' Key', k, ' ') as user_key",
            "if(k % 11 = 0, ' x', concat('Name ', k)) as name",
            "case when k % 13 = 0 then 'owner' when k % 3 = 0 then 'admin' else 'user' end as role",
            "if(k % 7 <> 0, value > 20, null) as active", "ts as changed_at", "event_id",
        )

    @cached_property
    def category_changes(self) -> DataFrame:
        return self.events("view").selectExpr(
            "concat('Brand#', k) as id", "if(k % 17 = 0, ' x ', concat(' Title ', event_id, ' ')) as title",
            "if(value > 20, concat('icon-', event_id), null) as icon_data_url",
            "if(user_id % 3 <> 0, value > 10, null) as active", "ts as changed_at", "event_id",
        )

    @cached_property
    def product_changes(self) -> DataFrame:
        return self.events("error").selectExpr(
            "k * 3 as id", "concat(' Item ', k, ' ') as name",
            "if(user_id % 2 = 0, concat('text ', event_id), null) as description",
            "cast(cast(value as decimal(10,2)) - 1 as decimal(12,3)) as price",
            "if(k % 5 <> 0, concat('Brand#', k), null) as category_id",
            "if(value > 40, 'new-icon', null) as icon_data_url",
            "if(user_id % 4 <> 0, value > 60, null) as excluded_from_revenue",
            "if(user_id % 5 <> 0, value > 5, null) as active", "ts as changed_at", "event_id",
        )

    @cached_property
    def payment_posts(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "cast(o_orderkey as string) as id", "o_custkey as user_id",
            "cast(cast(o_totalprice as decimal(10,2)) - 100000 as decimal(12,3)) as amount",
            "if(o_orderpriority <> '5-LOW', o_orderpriority, null) as note", "cast(null as bigint) as created_by",
            "o_orderdate as created_at",
        )

    @cached_property
    def adjustment_posts(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "cast(c_custkey as string) as id", "c_custkey as user_id",
            "cast(cast(c_acctbal as decimal(10,2)) * (c_nationkey % 5) as decimal(12,3)) as amount",
            "if(c_mktsegment <> 'BUILDING', c_mktsegment, null) as note", "cast(null as bigint) as created_by",
            f"{OPENING_DAY} as created_at",
        )

    @cached_property
    def deletion_requests(self) -> DataFrame:
        """Every booking with line status O is asked to be deleted a day after it was made."""
        return self.entries.where("line_status = 'O'").selectExpr(
            "id", "created_at + interval 1 day as deleted_at", "user_id as deleted_by",
            "if(tax > 0, 'Storno', null) as reason",
        )

    @cached_property
    def status_changes(self) -> DataFrame:
        return self.events("view").selectExpr(
            "k as id", "element_at(array('open', 'added', 'rejected', 'later'), cast(event_id % 4 + 1 as int)) as status",
            "ts as changed_at", "event_id",
        )

    @cached_property
    def suggestion_posts(self) -> DataFrame:
        posts = self.raw("benchmark").selectExpr(
            "item_id as id", "if(item_id % 7 = 3, ' x ', concat('  ', text, ' ')) as title", "cast(null as string) as description",
            f"{post_time('item_id')} as created_at",
        )
        return posts.withColumn("created_by", self.member_number("id"))

    @cached_property
    def moderation_requests(self) -> DataFrame:
        """The author asks when the turn is even, the next member when it is odd."""
        requested_by = F.when(F.expr("turn % 2 = 0"), F.col("user_id")).otherwise(self.member_number("user_id + 1"))
        return self.news_comments.select(F.col("id").alias("comment_id"), requested_by.alias("requested_by"))

    @cached_property
    def deleted_news(self) -> DataFrame:
        """Posts labelled toxic are taken down."""
        return self.raw("labels").where("toxic = 1").selectExpr("doc_id as id")

    @cached_property
    def deleted_categories(self) -> DataFrame:
        """Brands named in the errors with a high value."""
        return self.events("error").where("value > 100").selectExpr("concat('Brand#', k) as id")

    @cached_property
    def paid_members(self) -> DataFrame:
        return self.raw("customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as user_id")

    @cached_property
    def found_titles(self) -> DataFrame:
        """Category titles named in the product file: brands and types."""
        return self.raw("part").selectExpr("inline(array(struct(p_brand as title), struct(p_type as title)))")

    @cached_property
    def first_version_products(self) -> DataFrame:
        """Products as stored before descriptions, categories, icons and exclusion existed."""
        return self.products.select("id", "name", "price", "active", "created_at")
