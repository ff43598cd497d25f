"""Records to exclude because residue or a notice stands in place of their content.

A page's own lines (what its host puts around them set aside) are compared with the page's
address and title and with all other pages. A line is low information if it is repeated on
pages of at least MIN_SITES sites under MIN_SLUGS different slugs, hardly ever names the page
it stands on (shares a word with the slug, or with a title that agrees with the slug), and
stands beside unrepeated running text of a page's own on fewer pages than without any. A page is excluded if such lines, or
lines the placeholder, filler and notice detectors of residue.py know, are all it has. The host
evidence needs no phrase list; the lists add notices too rare to be learned.

Scale: one pass over the records writes hashed lines; of these only lines that occur MIN_PAGES times
or more go on. All statistics are sums and distinct pairs with partial aggregation, so a notice on a
third of all pages is a few rows per task. Every line of every page counts.

Defined cases: as in residue.py; pages without own lines (empty bodies, redirects) are no case; a
page cut after its headline is none, because the headline stands on articles elsewhere or is
not repeated; syndicated articles are none, because they stand under one slug.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.llm.boilerplate import CLASS_OF, CLASSES, CONTENT, PageModel
from petrel.llm.pages import CONTENT_TAGS, html_lines, response_page, site_label, squashed, text_of
from petrel.llm.residue import line_key, line_kind, slug_words, url_unfilled
from petrel.storage import written

SCHEMA = (
    "row_id bigint, type string, unfilled_url boolean, site bigint, slug bigint, n_known int, n_open int, n_open_running int, n_running int, "
    "lines array<struct<key:bigint,known:boolean,running:boolean,named:boolean>>, article array<struct<line_no:bigint,text:string>>"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
MIN_PAGES, MIN_SITES, MIN_SLUGS, ELSEWHERE_RATE, NAMED_RATE = 3, 3, 3, 1.0, 0.1
RUNNING = CLASS_OF == CLASSES.index("para")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _names_site(text: str, label: str) -> bool:
    """Whether a line is the site's own name and nothing else."""
    first = text[:1].lower()
    return bool(label) and not (first.isalnum() and first.isascii() and first != label[0]) and squashed(text) == label


def _response_lines(content: bytes, label: str) -> tuple[list[tuple[str, bool]], str]:
    """(own lines of an HTML message, each with whether it is running text; its title)."""
    _, page, _ = response_page(content)
    lines, _ = html_lines(page)
    own = [(line.text, line.tag in ("p", "blockquote", "pre", "td")) for line in lines if line.tag in CONTENT_TAGS or line.tag == "body"]
    return [(t, running) for t, running in own if not _names_site(t, label)], next((line.text for line in lines if line.tag == "title"), "")


def judge(records: DataFrame, model: PageModel, page_batch: int = 256) -> DataFrame:
    """One row per record: its own lines as keys with what is known of them, and the article's lines of extracted texts (see SCHEMA)."""
    shared = records.sparkSession.sparkContext.broadcast(model)

    def row(row_id: int, kind: str, url: str | None, own: list[tuple[str, bool]], title: str, article: list[tuple[int, str]]) -> tuple:
        slug = slug_words(url)
        names = slug | title_words if slug & (title_words := slug_words(f"x://x/{title}")) else slug
        lines = []
        for t, running in own:
            key = line_key(t.rsplit(" > ", 1)[-1])  # of a path of sections the last one counts
            lines.append((_hash(key), line_kind(t) is not None, running, bool(names) and not names.isdisjoint(key.split())))
        known = sum(k for _, k, _, _ in lines)
        open_running = sum(r and not k for _, k, r, _ in lines)
        return (row_id, kind, url_unfilled(url), _hash(site_label(url)), _hash(" ".join(sorted(slug))), known, len(lines) - known, open_running, sum(r for _, _, r, _ in lines), lines, article)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for at in range(0, len(batch), page_batch):
                part = batch.iloc[at : at + page_batch]
                plain = [(i, u, text_of(c).split("\n"), site_label(u)) for i, k, u, c in zip(part["row_id"], part["type"], part["url"], part["content"]) if k == "conversion" and c is not None]
                rows = []
                for (row_id, url, page, label), (numbers, texts, belief) in zip(plain, m.marginals([(p, label) for _, _, p, label in plain])):
                    own, article = [], []
                    mine = (belief[:, CONTENT].sum(1) >= 0.5).tolist() if m.trained else [True] * len(numbers)
                    for no, text, keep, para in zip(numbers, texts, mine, (belief[:, RUNNING].sum(1) >= 0.5).tolist()):
                        if keep:
                            article.append((no, page[no - 1]))
                        if (keep and not _names_site(text, label)) or line_kind(text):
                            own.append((text, para))
                    rows.append(row(row_id, "conversion", url, own, "", article))
                for row_id, kind, url, content in zip(part["row_id"], part["type"], part["url"], part["content"]):
                    if kind == "response" and content is not None:
                        own, title = _response_lines(content, site_label(url))
                        rows.append(row(row_id, kind, url, own, title, []))
                    elif kind != "conversion" or content is None:
                        rows.append(row(row_id, kind, url, [], "", []))
                yield pd.DataFrame(rows, columns=COLUMNS)

    needed = F.when(F.col("type").isin("response", "conversion"), F.col("content"))
    return records.select("row_id", "url", "type", needed.alias("content")).mapInPandas(run, SCHEMA)


def low_information(judged: DataFrame) -> DataFrame:
    """(row_id, key, known, running) of every line that host evidence shows to stand in place of content."""
    lines = judged.where(F.size("lines") > 0).select("row_id", "site", "slug", F.explode("lines").alias("l")).select("row_id", "site", "slug", "l.*")
    often = lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    kept = written(lines.join(often.select("key"), "key", "left_semi"), "frequent-lines")

    def spread(of: str, least: int) -> DataFrame:
        return kept.select("key", of).distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")

    repeated = written(kept.join(spread("site", MIN_SITES).join(spread("slug", MIN_SLUGS), "key"), "key", "left_semi"), "repeated-lines")
    # a page is bare if each of its running lines is repeated elsewhere
    again = repeated.groupBy("row_id").agg(F.count_if("running").alias("again"))
    bare = judged.where(F.size("lines") > 0).select("row_id", "n_running").join(again, "row_id").select("row_id", (F.col("n_running") <= F.col("again")).alias("bare"))
    uses = repeated.join(bare, "row_id")
    sites = uses.where("bare").groupBy("key", "site").agg(F.count("*").alias("n"), F.count_if("named").alias("named")).groupBy("key").agg(F.sum("n").alias("n"), F.sum("named").alias("named"), F.count("*").alias("sites"))
    beside = uses.where("not bare").groupBy("key").agg(F.count("*").alias("beside"))
    learned = sites.join(beside, "key", "left").where(
        (F.col("n") >= MIN_PAGES) & (F.col("sites") >= MIN_SITES) & (F.coalesce("beside", F.lit(0)) <= ELSEWHERE_RATE * F.col("n")) & (F.col("named") <= NAMED_RATE * F.col("n"))
    )
    return repeated.join(learned.select("key"), "key", "left_semi").select("row_id", "key", "known", "running")


def excluded_pages(judged: DataFrame) -> DataFrame:
    """row_id and reason (learned notice, residue) of the pages that have nothing but low-information lines."""
    mine = low_information(judged).groupBy("row_id").agg(F.count("*").alias("learned"), F.count_if(~F.col("known")).alias("learned_open"), F.count_if(F.col("running") & ~F.col("known")).alias("learned_running"))
    counts = judged.where(F.size("lines") > 0).select("row_id", "type", "n_known", "n_open", "n_open_running", F.size("lines").alias("n"))
    both = counts.join(mine, "row_id", "left").na.fill(0, ["learned", "learned_open", "learned_running"])
    # of an HTML message every line must be explained, of extracted text the running ones: there a role may be mistaken
    left = F.when(F.col("type") == "response", F.col("n_open") - F.col("learned_open")).otherwise(F.col("n_open_running") - F.col("learned_running"))
    found = both.where((F.col("n_known") + F.col("learned") > 0) & (left == 0))
    return found.select("row_id", F.when(F.col("learned") == F.col("n"), F.lit("learned notice")).otherwise(F.lit("residue")).alias("reason"))


def residue_records(records: DataFrame, model: PageModel) -> DataFrame:
    """row_id and reason (learned notice, residue, address) of the records to exclude."""
    judged = written(judge(records, model), "judged-pages")
    pages = written(excluded_pages(judged), "excluded-pages")
    unfilled = judged.where("unfilled_url").select("row_id", F.lit("address").alias("reason"))
    return pages.unionByName(unfilled.join(pages, "row_id", "left_anti"))


def article_lines(records: DataFrame, model: PageModel) -> DataFrame:
    """row_id, line_no (from 1) and text of the lines of each extracted page's own article, none on pages that are excluded."""
    judged = written(judge(records, model), "judged-pages")
    kept = judged.where((F.col("type") == "conversion") & (F.size("article") > 0)).join(excluded_pages(judged), "row_id", "left_anti")
    return kept.select("row_id", F.explode("article").alias("a")).select("row_id", "a.*")
