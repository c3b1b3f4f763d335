"""Readers of search pages, event feeds, benchmark files, deletion jobs and labelled accounts.

Pages arrive as JSON, one a row: a file of lines, a stream, or a Python data source
that fetches them.  All parsing is in DataFrame functions.
"""

from __future__ import annotations

import itertools
import json
import random
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_METRICS = "like_count INT, retweet_count INT, reply_count INT, quote_count INT, impression_count INT"
PAGE = f"""data ARRAY<STRUCT<id STRING, text STRING, created_at STRING, author_id STRING, lang STRING, conversation_id STRING, in_reply_to_user_id STRING,
 referenced_tweets ARRAY<STRUCT<type STRING, id STRING>>, public_metrics STRUCT<{_METRICS}>, attachments STRUCT<media_keys ARRAY<STRING>>>>,
 includes STRUCT<users ARRAY<STRUCT<id STRING, username STRING, name STRING, created_at STRING, verified BOOLEAN, description STRING, location STRING, profile_image_url STRING,
 public_metrics STRUCT<followers_count INT, following_count INT, tweet_count INT, listed_count INT>>>,
 media ARRAY<STRUCT<media_key STRING, type STRING, url STRING, preview_image_url STRING, alt_text STRING, width INT, height INT>>>,
 meta STRUCT<result_count INT, next_token STRING>"""


def naive_utc(text: Column) -> Column:
    """ISO text with `Z` or an offset, as a time without zone in UTC."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")


def parse_user(user: Column) -> Column:
    m = user["public_metrics"]
    count = lambda c: F.coalesce(m[c], F.lit(0))
    return F.when(
        user.isNotNull(),
        F.struct(
            user["id"].alias("id"), user["username"].alias("username"), user["name"].alias("display_name"), naive_utc(user["created_at"]).alias("created_at"),
            *[count(c).alias(c) for c in ("followers_count", "following_count", "tweet_count", "listed_count")],
            F.coalesce(user["verified"], F.lit(False)).alias("verified"), user["description"].alias("description"), user["location"].alias("location"),
            user["profile_image_url"].alias("profile_image_url"), F.coalesce(user["profile_image_url"].contains("default_profile"), F.lit(False)).alias("has_default_profile_image"),
        ),
    )


def parse_pages(pages: DataFrame, column: str = "page") -> DataFrame:
    """One row per post of JSON pages: its author and media are looked up in the page's includes.

    A missing author is null; an unknown media key gives a stub with its key alone.
    """
    page = pages.select(F.from_json(column, PAGE).alias("p")).select("p.*")
    keyed = lambda items, key: F.map_from_entries(F.transform(F.array_distinct(F.coalesce(items, F.array())), lambda x: F.struct(x[key].alias("key"), x.alias("value"))))
    looked = page.select(F.explode("data").alias("d"), keyed(F.col("includes.users"), "id").alias("users"), keyed(F.col("includes.media"), "media_key").alias("media"))
    d = F.col("d")
    zero = lambda c: F.coalesce(d["public_metrics"][c], F.lit(0)).alias(c)
    found = lambda k: F.try_element_at("media", k)
    media = F.transform(
        F.coalesce(d["attachments"]["media_keys"], F.array().cast("array<string>")),
        lambda k: F.struct(k.alias("media_key"), F.coalesce(found(k)["type"], F.lit("photo")).alias("type"), F.coalesce(found(k)["url"], found(k)["preview_image_url"]).alias("url"), found(k)["alt_text"].alias("alt_text"), found(k)["width"].alias("width"), found(k)["height"].alias("height")),
    )
    return looked.select(
        d["id"].alias("id"), d["text"].alias("text"), naive_utc(d["created_at"]).alias("created_at"), d["author_id"].alias("author_id"), parse_user(F.try_element_at("users", d["author_id"])).alias("author"),
        d["lang"].alias("lang"), d["conversation_id"].alias("conversation_id"), d["in_reply_to_user_id"].alias("in_reply_to_user_id"),
        F.coalesce(d["referenced_tweets"], F.array().cast("array<struct<type:string,id:string>>")).alias("referenced"),
        F.struct(*[zero(c) for c in ("like_count", "retweet_count", "reply_count", "quote_count", "impression_count")]).alias("engagement"), media.alias("media"), F.to_json(d).alias("raw"),
    )


def reference(kind: str) -> Column:
    """The id that a post refers to as `replied_to`, `quoted` or `retweeted`."""
    return F.get(F.filter("referenced", lambda r: r["type"] == kind), F.lit(0))["id"]


def references(parent: str, quoted: str, retweeted: str) -> Column:
    """The array of references, from three id columns."""
    kinds = [("replied_to", parent), ("quoted", quoted), ("retweeted", retweeted)]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("type"), F.col(c).cast("string").alias("id")) for k, c in kinds]), lambda r: r["id"].isNotNull())


def next_cursor(posts: DataFrame, by: str = "query") -> DataFrame:
    """(query, since_id, n): the greatest id, where longer digit strings are greater."""
    return posts.groupBy(by).agg(F.max_by("id", F.struct(F.length("id"), F.col("id"))).alias("since_id"), F.count(F.lit(1)).alias("n"))


def merge_cursor(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    both = stored.select("query", "since_id", "n").union(fresh.select("query", "since_id", "n"))
    return both.groupBy("query").agg(F.max_by("since_id", F.struct(F.length("since_id"), F.col("since_id"))).alias("since_id"), F.sum("n").alias("n"))


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Lines {text, label, group}; blank lines are skipped."""
    return spark.read.schema("text STRING, label INT, `group` STRING").json(path).where("text is not null")


def deletions(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a compliance job that must go."""
    rows = spark.read.schema("id STRING, action STRING, reason STRING").json(path)
    return rows.where(F.col("action").isin("delete", "withhold") | F.col("reason").isin("deleted", "suspended", "protected")).select("id").distinct()


def feed_events(rows: DataFrame) -> DataFrame:
    """(date, title, url, source, category) of feed articles whose seen date begins with eight digits."""
    return rows.select(F.try_to_timestamp(F.substring("seendate", 1, 8), F.lit("yyyyMMdd")).cast("timestamp_ntz").alias("date"), F.substring("title", 1, 512).alias("title"), "url", F.col("domain").alias("source"), F.lit("news").alias("category")).where("date is not null")


def labelled_accounts(spark: SparkSession, labels: str, users: str, posts: str) -> DataFrame:
    """Account features and bot labels of a labelled dump: label CSV, user JSON and post JSON."""
    label = spark.read.option("header", True).csv(labels).select("id", (F.col("label") == "bot").cast("int").alias("label"))
    user = spark.read.json(users)
    m = F.col("public_metrics")
    counts = spark.read.json(posts).groupBy(F.concat(F.lit("u"), F.col("author_id").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("n_posts"), F.countDistinct("text").alias("n_texts"))
    flat = user.select("id", m["followers_count"].alias("followers"), m["following_count"].alias("following"), m["tweet_count"].alias("tweets"), F.coalesce("verified", F.lit(False)).cast("int").alias("verified"), F.regexp_count("username", F.lit("[0-9]")).alias("digits"))
    return label.join(flat, "id").join(counts, "id", "left").fillna(0, ["n_posts", "n_texts"])


def backoff(attempt: int, base: float = 1.0, cap: float = 60.0, draw: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds to wait before retry `attempt`, with full jitter."""
    return draw(0.0, min(cap, base * 2**attempt))


def fetch(url: str, get: Callable[[str], tuple[int, dict, str]], sleep: Callable[[float], None] = time.sleep, retries: int = 5) -> str:
    """The body of a request that is repeated on rate limits, server errors and lost connections."""
    for attempt in range(retries + 1):
        try:
            status, headers, body = get(url)
        except OSError:
            status, headers, body = 599, {}, ""
        if status < 400:
            return body
        if status != 429 and status < 500 or attempt == retries:
            raise OSError(f"{url}: status {status}")
        reset = headers.get("x-rate-limit-reset")
        sleep(max(0.0, float(reset) - time.time()) if status == 429 and reset else backoff(attempt))
    raise AssertionError


class SearchPages(DataSource):
    """`spark.read.format("search_pages")`: one partition per query, one row per page.

    Options: url (with {query}, {token}, {since} and {size}), queries (a JSON list), since
    (a JSON map query to id), page_size (10 to 100, others are set to the nearer bound),
    max_pages.  All pages are read; with max_pages, a search that has more is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return "query string, page string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in json.loads(self.options["queries"])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        token, since = "", json.loads(self.options.get("since", "{}")).get(partition.query, "")
        most, size = int(self.options.get("max_pages", "0")), min(100, max(10, int(self.options.get("page_size", "100"))))
        for page in itertools.count(1):
            body = _search(self.options, partition.query, since, "", token, size)
            yield partition.query, body
            token = (json.loads(body).get("meta") or {}).get("next_token") or ""
            if not token:
                return
            if page == most:
                raise ValueError(f"{partition.query} has more than {most} pages")


def _later(a: str, b: str) -> str:
    """The greater id; longer digit strings are greater."""
    return max(a, b, key=lambda i: (len(i), i))


class SearchStream(DataSource):
    """`spark.readStream.format("search_stream")`: searches as a stream whose offset is the last id of each query.

    A batch reads the ids after its start and up to its end, however many pages they are,
    one partition a query; both are in the checkpoint, so a batch that failed is read
    again with the same ids, and posts that came meanwhile are left to the next.

    Options: url (with {query}, {since}, {until}, {token} and {size}), queries (a JSON list), since
    (a JSON map query to the id to begin after), page_size, marks (a shared folder for the
    greatest ids seen, so that an offset never falls back after a restart while a search finds nothing).
    """

    @classmethod
    def name(cls) -> str:
        return "search_stream"

    def schema(self) -> str:
        return "query string, id string, page string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SearchReader(dict(self.options))


class _Span(InputPartition):
    def __init__(self, query: str, since: str, until: str):
        self.query, self.since, self.until = query, since, until


class _SearchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.queries = options, json.loads(options["queries"])
        self.seen: dict[str, str] = {}

    def _marks(self) -> tuple:
        from pyarrow import fs

        place = self.options["marks"]
        files, path = fs.FileSystem.from_uri(place if "://" in place else f"file://{place}")
        return files, f"{path.rstrip('/')}/marks.json"

    def _kept(self) -> dict[str, str]:
        if "marks" not in self.options:
            return self.seen
        files, path = self._marks()
        if files.get_file_info(path).is_file:
            with files.open_input_stream(path) as f:
                return json.loads(f.read())
        return {}

    def _keep(self, found: dict[str, str]) -> None:
        self.seen = found
        if "marks" in self.options:
            files, path = self._marks()
            files.create_dir(path.rsplit("/", 1)[0])
            with files.open_output_stream(path + ".new") as f:
                f.write(json.dumps(found).encode())
            files.move(path + ".new", path)

    def initialOffset(self) -> dict:
        given = json.loads(self.options.get("since", "{}"))
        return {q: given.get(q, "") for q in self.queries}

    def latestOffset(self) -> dict:
        found, kept = {}, self._kept()
        for query in self.queries:
            page = json.loads(_search(self.options, query, "", "", "", int(self.options.get("page_size", "100"))))
            ids = [p["id"] for p in page.get("data") or []] + [(page.get("meta") or {}).get("newest_id") or ""]
            newest = kept.get(query, "")
            for i in ids:
                newest = _later(newest, i)
            found[query] = newest
        self._keep(found)
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = [_Span(q, start.get(q, ""), end.get(q, "")) for q in self.queries]
        return [s for s in spans if s.until and s.until != s.since and _later(s.since, s.until) == s.until]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str]]:
        """A row for each post: its page with this post alone, which :func:`parse_pages` reads."""
        token = ""
        while True:
            page = json.loads(_search(self.options, partition.query, partition.since, partition.until, token, int(self.options.get("page_size", "100"))))
            for post in page.get("data") or []:
                if post["id"] != partition.since and _later(post["id"], partition.since) == post["id"] and _later(post["id"], partition.until) == partition.until:
                    yield partition.query, post["id"], json.dumps({"data": [post], "includes": page.get("includes") or {}})
            token = (page.get("meta") or {}).get("next_token") or ""
            if not token:
                return

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _search(options: dict, query: str, since: str, until: str, token: str, size: int) -> str:
    url = options["url"]
    for name, value in (("query", query), ("token", token), ("since", since), ("until", until), ("size", str(size))):
        url = url.replace("{" + name + "}", quote(value))
    return fetch(url, _get)


def _get(url: str) -> tuple[int, dict, str]:
    try:
        with urlopen(url, timeout=30) as reply:
            return reply.status if reply.status is not None else 200, dict(reply.headers), reply.read().decode()
    except HTTPError as error:
        return error.code, dict(error.headers), ""


def lookup(ids: DataFrame, url: str, get: Callable[[str], tuple[int, dict, str]], key: str = "post_id", size: int = 100) -> DataFrame:
    """(page): answers to requests for the given ids, `size` of them in each; url holds {ids}.

    Ids are dealt over the tasks and asked for where they are, so any number of them
    can be looked up; `get` is called in the tasks.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for batch in batches:
            held += batch["id"].tolist()
            while len(held) >= size:
                yield pd.DataFrame({"page": [fetch(url.replace("{ids}", ",".join(held[:size])), get)]})
                held = held[size:]
        if held:
            yield pd.DataFrame({"page": [fetch(url.replace("{ids}", ",".join(held)), get)]})

    wanted = ids.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id")).distinct()
    return wanted.mapInPandas(ask, "page string")
