"""Thread stitching (D1, D2, E2) and prompt rendering (C4).

Submissions and comments are joined on the thread key (equi-join, sort-merge at
scale; AQE splits a hot thread).  Only the author's own replies are collected per
submission -- the bulk of the comments stay one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import text as T

# The reply preamble and quote prefix of a stitched post, and the
# verdict prompt templates for posts and comments.
REPLY_HEADER = "\n\nThe author also replied with the following in the thread:"
REPLY_PREFIX = "\n> "
POST_TEMPLATE = ("\n\n## Subreddit \n> This post was found on the subreddit r/{subreddit}."
                 "\n\n## Title \n> This post was titled: {title}"
                 "\n\n## Date Created \n> This post was created on {date_created}."
                 "\n\n## Post \n> {post}"
                 "\n\n> Answer Yes if the post is relevant and No otherwise, and nothing more."
                 "\n\n## Your Answer \n>")
COMMENT_TEMPLATE = ("\n\n## Subreddit \n> This comment was found on the subreddit r/{subreddit}."
                    "\n\n## Title \n> This comment was in response to a post titled: {title}"
                    "\n\n## Date Created \n> This comment was created on {date_created}."
                    "\n\n## Comment \n> {post}"
                    "\n\n> Answer Yes if the comment is relevant and No otherwise, and nothing more."
                    "\n## Your Answer \n>")
EXTRACT_POST_TEMPLATE = ("\n\n## Subreddit \n> This post was found on the subreddit r/{subreddit}."
                         "\n\n## Title \n> This post was titled: {title}"
                         "\n\n## Date Created \n> This post was created on {date_created}."
                         "\n\n## Post \n> {post}"
                         "\n\n## Output \n>")
EXTRACT_COMMENT_TEMPLATE = ("\n\n## Subreddit \n> This comment was found on the subreddit r/{subreddit}."
                            "\n\n## Title \n> This comment was in response to a post titled: {title}"
                            "\n\n## Date Created \n> This comment was created on {date_created}."
                            "\n\n## Comment \n> {post}"
                            "\n\n## Output \n>")


def stitch(submissions: DataFrame, comments: DataFrame, key: str = "thread_key", sub_id: str = "sub_id",
           seq: str = "seq", author: str = "author", sub_text: str = "selftext", com_text: str = "body",
           forum: str = "subreddit") -> DataFrame:
    """Build context posts.

    submissions: sub_id, thread_key, subreddit, title, selftext, score, created_utc, permalink, author
    comments:    seq, thread_key, subreddit, body, score, created_utc, permalink, author

    A thread is a (forum, thread key) pair: the same title slug in another forum is another
    thread.  ``sub_id`` may be of any type.

    Output: sub_id, seq (NULL for the submission row), is_comment, subreddit, title,
    initial_post, post, score, created_utc, permalink, author_replies.
    Null authors never match (plain ``=``, not ``<=>``)."""
    keys = [key, forum]
    subs = submissions.select(sub_id, *keys, "title", F.col(sub_text).alias("_selftext"), "score",
                              "created_utc", "permalink", F.col(author).alias("_sub_author"))
    com = comments.select(seq, *keys, F.col(com_text).alias("_body"), F.col("score").alias("_c_score"),
                          F.col("created_utc").alias("_c_created"), F.col("permalink").alias("_c_permalink"),
                          F.col(author).alias("_c_author"))
    # The author's own replies first, once a (thread, author) whatever the number of
    # submissions on the slug; inside coalesce the author is no join key, so the comments
    # stay partitioned by thread
    authors = subs.select(*keys, F.col("_sub_author").alias("_r_author")).distinct()
    own = F.coalesce(F.col("_c_author") == F.col("_r_author"), F.lit(False))
    replies = (com.join(authors.withColumnsRenamed({key: "_r_key", forum: "_r_forum"}),
                        (F.col(key) == F.col("_r_key")) & (F.col(forum) == F.col("_r_forum")) & own)
               .groupBy("_r_key", "_r_forum", "_r_author")
               .agg(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("_body").alias("b"))))
                    .alias("_r")))                                               # E2
    mine = ((F.col(key) == F.col("_r_key")) & (F.col(forum) == F.col("_r_forum"))
            & F.coalesce(F.col("_sub_author") == F.col("_r_author"), F.lit(False)))
    posts = (subs.join(replies, mine, "left")
             .withColumn("author_replies", F.coalesce(F.transform("_r", lambda r: r["b"]),
                                                      F.array().cast("array<string>")))
             .withColumn("post", F.when(F.size("author_replies") > 0,
                                        F.concat(F.col("_selftext"), F.lit(REPLY_HEADER),
                                                 F.array_join(F.transform("author_replies",
                                                                          lambda b: F.concat(F.lit(REPLY_PREFIX), b)),
                                                              "")))
                         .otherwise(F.col("_selftext")))
             .drop("_r", "_r_key", "_r_forum", "_r_author"))
    sub_rows = posts.select(sub_id, F.lit(None).cast("bigint").alias(seq), F.lit(False).alias("is_comment"),
                            F.col(forum).alias("subreddit"), "title", F.lit("").alias("initial_post"), "post", "score", "created_utc",
                            "permalink", "author_replies")
    # Every other comment meets the stitched submissions of its thread, once
    p = posts.select(sub_id, F.col(key).alias("_p_key"), F.col(forum).alias("_p_forum"), F.col("_sub_author").alias("_p_author"),
                     "title", F.col("post").alias("initial_post"))
    by_author = F.coalesce(F.col("_c_author") == F.col("_p_author"), F.lit(False))
    com_rows = (com.join(p, (F.col(key) == F.col("_p_key")) & (F.col(forum) == F.col("_p_forum"))).where(~by_author)
                .select(sub_id, F.col(seq).cast("bigint").alias(seq), F.lit(True).alias("is_comment"),
                        F.col(forum).alias("subreddit"),
                        "title", "initial_post", F.col("_body").alias("post"), F.col("_c_score").alias("score"),
                        F.col("_c_created").alias("created_utc"), F.col("_c_permalink").alias("permalink"),
                        F.array().cast("array<string>").alias("author_replies")))
    return sub_rows.unionByName(com_rows)


def render_posts(df: DataFrame, out: str = "prompt", variant: str = "verdict") -> DataFrame:
    """C4: prompt per context post; template chosen by ``is_comment``.  ``variant``:
    'verdict' (relevance question) or 'extraction' (output slot)."""
    def fill(tpl):
        parts, cols = [], []
        rest = tpl
        for name in ("subreddit", "title", "date_created", "post"):
            a, rest = rest.split("{" + name + "}", 1)
            parts.append(F.lit(a))
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        parts.append(F.lit(rest))
        return F.concat(*parts)
    with_date = df.withColumn("date_created", T.utc_date("created_utc")) if "date_created" not in df.columns else df
    post_t, com_t = (POST_TEMPLATE, COMMENT_TEMPLATE) if variant == "verdict" else \
        (EXTRACT_POST_TEMPLATE, EXTRACT_COMMENT_TEMPLATE)
    return with_date.withColumn(out, F.when(F.col("is_comment"), fill(com_t)).otherwise(fill(post_t)))
