"""The training-text operators on small fixtures, against brute force where SQL can't say it."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrel.llm import boilerplate, exclusion, history, leaks, mixing, pages, personal, plans, residue, truncation, words
from petrel.llm.personal_training import labelled_texts, trained_model

WORDS = "harbour lantern ferry bridge garden clerk market window paper letter winter morning record engine signal copper basket ladder orchard castle river stone table candle mirror hammer pocket silver".split()


def sentence(r, n=12):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(r, site="Copper Herald", cut=None, title=None):
    title = title or " ".join(r.choice(WORDS) for _ in range(5)).capitalize()
    body = [sentence(r) + " " + sentence(r) for _ in range(3)]
    footers = [("footer", f"© 2010 {site}. All rights reserved."), ("footer", "About us · Advertise"), ("footer", "Back to top")]
    r.shuffle(footers)
    parts = [("nav", "Home | News | Sport | Contact"), ("h1", title), ("p", body[0]), ("h2", "About the " + r.choice(WORDS)), ("p", body[1]), ("p", body[2]), ("h4", "Most read"), ("a", "A day at the " + r.choice(WORDS)), ("a", "Why the " + r.choice(WORDS) + " matters"), *footers]
    html = "<html><head><title>x</title></head><body>\n" + "\n".join(f"<{t}>{x}</{t}>" for t, x in parts) + "\n</body></html>\n"
    text = "\n".join(x for _, x in parts)
    keep = [i for i, (t, _) in enumerate(parts, 1) if t in ("h1", "h2", "p")]
    return html, text, keep


def message(html, length=None, extra=""):
    body = html.encode()
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body) if length is None else length}\r\n{extra}\r\n".encode() + body


@pytest.fixture(scope="module")
def site(captures):
    """Pages of several hosts, each as a response and a conversion, with residue pages among them."""
    r, rows, keep = random.Random(3), [], {}
    for i in range(60):
        url = f"http://copper-herald.example/news/{r.choice(WORDS)}-{i}"
        html, text, lines = article(r)
        rows += [{"row_id": 2 * i, "type": "response", "url": url, "content": message(html), "harvester_id": i % 3}, {"row_id": 2 * i + 1, "type": "conversion", "url": url, "content": text.encode(), "harvester_id": i % 3}]
        keep[2 * i + 1] = lines
    return rows, keep


def test_words():
    assert words.plain_words("Élan-Vital, naïve_x ﬁ STRASSE straße 3") == ["elan", "vital", "naive", "x", "fi", "strasse", "strasse", "3"]
    assert words.plain_words(None) == words.words("") == [] and words.window_hashes(words.hashes(["a"]), 3).size == 0


# --- 1 and 5 -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://h/a/{{slug}}", True), ("http://h/a/%7B%7Bpost.url%7D%7D", True), ("http://h/a?ref=undefined", True), ("http://h/null", True), ("http://h/:id/3", True), ("http://h/a?x=[object%20Object]", True), ("http://h/a#{slug}", True), ("http://h/%25s", True), ("http://h/__URL__", True),
        ("http://h/null-island", False), ("http://h/undefined-behaviour?a=b", False), ("http://h/", False), (None, False), ("", False), ("http://h/a__b/x_y?id=", False), ("http://h/notes:idle", False), ("not an address", False),
    ],
)
def test_unfilled_addresses(url, want):
    assert residue.url_unfilled(url) is want


@pytest.mark.parametrize(
    "line, kind",
    [
        ("Posted in {{ a.b }} on ${date}", "placeholder"), ("&#123;&#123;x&#125;&#125;", "placeholder"), ("text text text text", "filler"), ("Lorem ipsum dolor sit amet elit.", "filler"), ("xxxx xxxx", "filler"), ("TBD", "filler"), ("404 - the page could not be found.", "notice"), ("Bitte aktivieren Sie JavaScript.", "notice"),
        ("A plain headline", None), ("", None), ("Editors write a name such as {{ visitor.name }} between double braces, and the press software fills it in later on.", None), (" ".join(f"word{k}" for k in range(5000)) + " not found", None),
    ],
)
def test_residue_lines(line, kind):
    assert residue.line_kind(line) == kind


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, -1, 4])
    depth, kind = np.array([0, 1, 1, 2, 0, 1]), np.array([0, 1, 0, 1, 0, 0])
    emit, pair, start = rng.random((6, 3)), rng.random((2, 3, 3)), rng.random(3)
    got = boilerplate.sum_product(parent, depth, kind, emit, pair, start)
    want = np.zeros((6, 3))
    for code in range(3**6):
        s = [code // 3**k % 3 for k in range(6)]
        p = np.prod([emit[i, s[i]] * (start[s[i]] if parent[i] < 0 else pair[kind[i], s[parent[i]], s[i]]) for i in range(6)])
        want[range(6), s] += p
    np.testing.assert_allclose(got, want / want.sum(1, keepdims=True), atol=1e-9)


def test_articles_and_residue(captures, site):
    rows, keep = site
    notice = "This page has been removed."
    odd = "Curtains are drawn today."  # known to no list: learned, for it stands alone on pages of several hosts
    more = [
        {"row_id": 1000, "type": "response", "url": "http://x.example/a", "content": message(f"<h1>{notice}</h1>")}, {"row_id": 1001, "type": "conversion", "url": "http://x.example/a", "content": f"Home | News | Sport | Contact\n{notice}\nAbout us · Advertise".encode()},
        {"row_id": 1002, "type": "request", "url": "http://x.example/{id}", "content": b"GET / HTTP/1.1\r\n\r\n"}, {"row_id": 1003, "type": "response", "url": "http://x.example/b", "content": b"HTTP/1.1 301 Moved\r\nContent-Length: 0\r\n\r\n"}, {"row_id": 1004, "type": "response", "url": None, "content": None},
        {"row_id": 1005, "type": "conversion", "url": None, "content": b""}, {"row_id": 1006, "type": None, "url": None}, {"row_id": 1007, "type": "conversion", "url": "http://y.example/z", "content":  " ".join(f"Harbour{k} clerk{k}." for k in range(30_000)).encode()},
        *[{"row_id": 1010 + k, "type": "response", "url": f"http://{h}.example/{w}", "content": message(f"<h1>{odd}</h1>")} for k, (h, w) in enumerate(zip(("p", "q", "s", "t"), WORDS))],
    ]
    df = captures(rows + more).withColumn("reason", F.lit("clash"))
    model = boilerplate.fit(boilerplate.training_pages(df, 40), epochs=8)
    got = {r.row_id: r.reason for r in exclusion.residue_records(df, model).collect()}
    assert got == {1000: "residue", 1001: "residue", 1002: "address", **{1010 + k: "learned notice" for k in range(4)}}
    found: dict[int, list[int]] = {}
    for r in exclusion.article_lines(df, model).collect():
        found.setdefault(r.row_id, []).append(r.line_no)
    right = sum(sorted(found.get(i, [])) == want for i, want in keep.items())
    assert right >= 0.9 * len(keep) and 1001 not in found and 1005 not in found
    none = df.limit(0)
    assert exclusion.residue_records(none, model).count() == 0 and exclusion.article_lines(none, model).count() == 0
    assert not boilerplate.fit(boilerplate.training_pages(none)).trained


def test_notices_are_told_from_articles_by_all_pages(captures):
    """A long notice no list knows is learned from sites and slugs; the same sentence inside an article, a headline and a syndicated article are no cases."""
    r = random.Random(8)
    notice = "Our curtains stay drawn for the whole afternoon while the painters look after every single board of the old stage, so kindly come again when the lamps are lit and the doors stand open."
    story = "<p>" + "</p><p>".join(sentence(r) for _ in range(3)) + "</p>"
    page = lambda i, host, slug, body: {"row_id": i, "type": "response", "url": f"http://{host}.example/{slug}", "content": message(f"<title>{slug}</title>{body}")}
    rows = [page(k, h, WORDS[k], f"<p>{notice}</p>") for k, h in enumerate("abcde")]
    rows += [page(10 + k, h, WORDS[k], f"<p>{sentence(r)}</p><p>{notice}</p>") for k, h in enumerate("abc")]
    rows += [page(20 + k, h, "one-story", story) for k, h in enumerate("abcde")]
    rows += [page(30 + k, h, w, f"<h1>News of the {w}</h1>") for k, (h, w) in enumerate(zip("abcde", WORDS))]
    df = captures(rows)
    got = {x.row_id: x.reason for x in exclusion.residue_records(df, boilerplate.PageModel()).collect()}
    assert got == dict.fromkeys(range(5), "learned notice")


def test_no_article_on_cases_of_residue(spark, captures, site, tmp_path, monkeypatch):
    rows, keep = site
    captures(rows).write.parquet(f"{tmp_path}/captures.parquet")
    cases = spark.createDataFrame([(1, "learned notice"), (3, "residue")], "row_id bigint, reason string")
    monkeypatch.setattr(exclusion, "excluded_pages", lambda *_: cases)
    found = {r.row_id for r in plans.p5_found(spark, str(tmp_path)).collect()}
    assert found == set(keep) - {1, 3}


# --- 2 -------------------------------------------------------------------------------------


def test_truncation(captures, site):
    rows, _ = site
    html, text, _ = article(random.Random(9))
    packed = gzip.compress(html.encode())
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n"
    whole, cut = {}, {}
    page = message(html)
    whole[2000] = ("response", page, None)
    whole[2001] = ("response", message(html.replace("</body></html>\n", "")), len(page) - 400)  # no closing tags, more than declared
    whole[2002] = ("conversion", text.encode(), None)
    whole[2003] = ("response", head + packed, None)
    cut[2010] = ("response", page[:-200], None)
    cut[2011] = ("response", page, len(page) + 1)
    cut[2012] = ("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n", None)
    cut[2013] = ("response", head + packed[:-20], None)
    cut[2014] = ("conversion", text[: text.index("About the") - 20].encode(), None)
    cut[2015] = ("conversion", (text[:300] + " [...]").encode(), None)
    cut[2016] = ("conversion", text.encode()[:-7], None)  # inside the last footer line
    near = text[: text.rindex(".", 0, text.index("Most read")) - 0]
    extra = [{"row_id": i, "type": t, "url": "http://copper-herald.example/q", "content": c, "content_length": n, "harvester_id": 7} for i, (t, c, n) in (whole | cut).items()]
    extra += [{"row_id": 2020, "type": "conversion", "content": None, "content_length": 5}, {"row_id": 2021, "type": "conversion", "content": b""}, {"row_id": 2022, "type": "resource", "content": b"x", "content_length": 9}]
    df = captures(rows + extra)
    got = {r.row_id: r.reason for r in truncation.truncated(df).collect()}
    assert {i for i, why in got.items() if why and i >= 2000} == set(cut), {i: got.get(i) for i in whole | cut}
    assert 2022 not in got and not any(got[i] for i in (2020, 2021)) and near
    assert sum(bool(got[r["row_id"]]) for r in rows) <= 0.03 * len(rows)
    assert truncation.truncated(df.limit(0)).count() == 0


def test_broken_closing_tags_are_no_cut(captures):
    """A page that holds all declared bytes and stops inside a closing tag is whole; inside an opening tag, or without a declared length, it is not."""
    html, _, _ = article(random.Random(4))
    closing, opening = html[: html.index("</html>") + 5], html[: html.rindex("<footer>") + 5]
    undeclared = b"HTTP/1.1 200 OK\r\n\r\n" + closing.encode()
    df = captures([{"row_id": i, "type": "response", "content": c} for i, c in enumerate((message(closing), message(opening), undeclared))])
    assert {x.row_id: x.reason for x in truncation.truncated(df).collect()} == {0: None, 1: "markup", 2: "markup"}


def test_hot_keys_go_on_to_finer_ones(captures):
    """A beginning shared by many more texts than HOT still lets each cut copy meet its whole one."""
    r = random.Random(5)
    start = " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(40))
    rows = []
    for k in range(3 * truncation.HOT):
        own = start + "\n" + " ".join(r.choice(WORDS) + str(r.randrange(9999)) for _ in range(60)) + " lanterns"
        rows += [{"row_id": 2 * k, "type": "conversion", "content": own.encode()}, {"row_id": 2 * k + 1, "type": "conversion", "content": own[:-4].encode()}]
    got = {x.row_id for x in truncation.truncated(captures(rows)).where("reason = 'alignment'").collect()}
    assert got == {row["row_id"] for row in rows if row["row_id"] % 2}


def test_hot_keys_leave_no_partner_out(captures, monkeypatch):
    """More than HOT nearly equal texts: each cut one meets its whole one, which is not the longest, and a smaller HOT changes nothing."""
    r = random.Random(21)
    fresh = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(9999)) for _ in range(n))
    body, rows = fresh(400), []
    for k in range(truncation.HOT + 8):
        own = body + "\n" + fresh(r.choice((2, 3, 6, 8))) + " lanterns"
        rows += [{"row_id": 3 * k, "type": "conversion", "content": own.encode()}, {"row_id": 3 * k + 1, "type": "conversion", "content": own[:-4].encode()}]
        rows.append({"row_id": 3 * k + 2, "type": "conversion", "content": (own + "\n" + fresh(2)).encode()})  # goes on, so the first one is whole
    df = captures(rows)
    reasons = lambda: {x.row_id: x.reason for x in truncation.truncated(df).collect()}
    got = reasons()
    assert {i for i, x in got.items() if x == "alignment"} == {row["row_id"] for row in rows if row["row_id"] % 3 == 1}
    for few in (2, 10**6):
        monkeypatch.setattr(truncation, "HOT", few)
        assert reasons() == got


def test_texts_without_partner_are_not_shuffled(spark, captures):
    """However large the joins are, only texts of candidate pairs enter a shuffle, and keys do once."""
    r = random.Random(8)
    rows = [{"row_id": k, "type": "conversion", "content": (" ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(2000)) + " lanterns").encode()} for k in range(100)]
    rows += [{"row_id": 200 + k, "type": "conversion", "content": rows[k]["content"][:-4]} for k in range(3)]
    df, core = captures(rows), spark.sparkContext._jsc.sc()

    def shuffled():
        core.listenerBus().waitUntilEmpty(30_000)
        return core.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if no side of a join were small
    try:
        got = {x.row_id for x in truncation.truncated(df).where("reason = 'alignment'").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {200, 201, 202}
    assert shuffled() - before < 0.5 * sum(len(x["content"]) for x in rows)


def test_sifted_leaves_none_out(spark, monkeypatch):
    rows, values = spark.range(20_000), spark.range(5000, 6000).withColumnRenamed("id", "value")
    got = {x.id for x in truncation.sifted(rows, "id", values).collect()}
    assert got >= set(range(5000, 6000)) and len(got) < 1500
    assert truncation.sifted(rows, "id", values.limit(0)).count() == 0
    monkeypatch.setattr(truncation, "SIEVE_WORDS", 1)  # full: nothing is sifted out
    assert truncation.sifted(rows, "id", values).count() == 20_000


def test_alignment():
    lines = ["one two three four five six", "seven eight nine ten eleven twelve and more words here"]
    assert truncation.aligned([lines[0], lines[1][:30]], lines) is True
    assert truncation.aligned(lines, lines) is False and truncation.aligned(["nothing of it here at all"], lines) is None


def test_further_copies_are_tried(captures):
    r = random.Random(12)
    fresh = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(n))
    body, furniture = fresh(60), [fresh(40) for _ in range(6)]
    early = fresh(120)
    texts = {
        1: body + " and the lanterns", 2: body + " and the lant",  # cut inside the last word: as many words
        **{10 + k: "\n".join([*furniture, fresh(30 + 9 * k)]) for k in range(8)}, 20: "\n".join([*furniture, fresh(8) + " harbour"]),
        30: early, 31: early[: len(early) // 3],  # a third is left
    }
    texts[21] = texts[20][:-3]  # other pages with the same furniture are longer
    df = captures([{"row_id": i, "type": "conversion", "content": t.encode()} for i, t in texts.items()])
    got = {x.row_id for x in truncation.truncated(df).where("reason = 'alignment'").collect()}
    assert got == {2, 21, 31}


# --- 7 -------------------------------------------------------------------------------------


def test_edit_distance():
    r = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(500):
        a = [r.randrange(4) for _ in range(r.randrange(12))]
        b = [x for x in a if r.random() > 0.2] + [1] * r.randrange(3)
        for limit in range(5):
            want = plain(a, b)
            assert history.edit_distance_within(np.array(a, int), np.array(b, int), limit) == (want if want <= limit else None)


def payload_rows():
    r, rows = random.Random(4), []
    for i in range(120):
        kind = r.random()
        if rows and kind < 0.5:
            w = r.choice(rows)["content"]
            w = (w or b"").decode().split()
            for _ in range(r.choice((0, 1, 3, 5, 9))):
                if w:
                    k = r.randrange(len(w))
                    r.choice((lambda: w.pop(k), lambda: w.insert(k, "new"), lambda: w.__setitem__(k, "other")))()
            text = " ".join(w)
            text = text.upper() if kind < 0.1 else text.replace(" ", ",  ") if kind < 0.2 else text
        else:
            text = " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(20, 130)))
        rows.append({"row_id": i, "type": "resource", "batch_id": 1 + i // 20, "content": text.encode()})
    return rows + [{"row_id": 900, "batch_id": 1, "content": None}, {"row_id": 901, "batch_id": 1, "content": b""}, {"row_id": 902, "batch_id": 2, "content": b"  ..."}, {"row_id": 903, "batch_id": None, "content": b"x"}, {"row_id": 904, "batch_id": 3, "content": b"X!"}]


def brute(rows):
    tokens = {x["row_id"]: words.words(x["content"].decode()) for x in rows if x["content"] is not None}
    at = {x["row_id"]: 2**31 - 1 if x["batch_id"] is None else x["batch_id"] for x in rows}
    h = {i: words.hashes(t) for i, t in tokens.items()}
    near = lambda i, j: history.edit_distance_within(h[i], h[j], max(len(h[i]), len(h[j])) // 20) is not None
    return {i for i in tokens if any(at[j] < at[i] and near(i, j) for j in tokens)}


def test_repeats_equal_brute_force(captures, tmp_path, monkeypatch):
    rows = payload_rows()
    df = captures(rows).withColumn("key", F.lit(1)).withColumn("how", F.lit("x"))
    want = brute(rows)
    assert {r.row_id for r in history.repeated_payloads(df).collect()} == want
    monkeypatch.setattr(history, "HOT", 2)  # the way for hot keys finds the same
    assert {r.row_id for r in history.repeated_payloads(df).collect()} == want
    found = set()
    for number, some in enumerate(((1,), (2, 3), (4,), (5, 6), (None,))):
        part = df.where(F.coalesce("batch_id", F.lit(-1)).isin([-1 if b is None else b for b in some]))
        got = {r.row_id for r in history.check_batch(part, str(tmp_path / "store"), number).collect()}
        if number in (1, 4):  # a repeated delivery finds the same and keeps nothing twice
            assert got == {r.row_id for r in history.check_batch(part, str(tmp_path / "store"), number).collect()}
        found |= got
    assert found == want
    assert df.sparkSession.read.parquet(str(tmp_path / "store" / "texts")).groupBy("digest").count().where("count > 1").count() == 0
    assert history.repeated_payloads(df.limit(0)).count() == 0


def test_head_and_tail_shares_are_added(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT", 1)
    r = random.Random(8)
    fresh = lambda n: [r.randrange(1 << 31) for _ in range(n)]
    texts = {1: (1, fresh(150)), 2: (2, (old := fresh(150))), 3: (3, [*old[:-1], 5])}
    part = history.COVERAGE * 0.9
    # text 2 is among the earliest of key 10, but of key 11 only behind text 1
    keys = [(10, 2, part), (10, 3, part), (11, 1, part), (11, 2, part), (11, 3, part)]
    frame = spark.createDataFrame([(i, b, t) for i, (b, t) in texts.items()], "id bigint, first_batch int, tokens array<int>")
    chunks = spark.createDataFrame([(k, i, texts[i][0], x) for k, i, x in keys], "key bigint, id bigint, first_batch int, share float")
    assert [x.id for x in history.near_earlier(frame, chunks).collect()] == [3]


def test_no_join_of_repeats_is_a_broadcast(captures, monkeypatch):
    """Stored tables look small, by their compressed files and arrays counted as one number, whatever they hold."""
    plans_seen = []

    def seen(df, name, write=history.written):
        plans_seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(history, "written", seen)
    seen(history.repeated_payloads(captures(payload_rows()[:40])), "repeats")
    assert len(plans_seen) > 5 and any("SortMergeJoin" in p for p in plans_seen)
    assert not [p for p in plans_seen if "Broadcast" in p]


def test_chunks_are_cut_by_content():
    r = random.Random(5)
    t = words.hashes([r.choice(WORDS) + str(r.randrange(99)) for _ in range(4000)])
    ends = history.chunk_ends(t)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(t) and sizes.max() <= history.MAX_CHUNK and sizes[:-1].min() >= history.MIN_CHUNK
    shifted = {k for k, _ in history.chunk_keys(np.concatenate((words.hashes(["x"]), t)))}
    assert len(shifted & {k for k, _ in history.chunk_keys(t)}) > 0.95 * len(shifted)


# --- 8, 9, 10 ------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(40))) for i in range(20)] + [(90, None), (91, "short one")]
    items.append((92, items[0][1]))
    docs = []
    for d in range(60):
        w = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(80)]
        if d % 2:
            part = r.choice(items[:20])[1].split()
            a, n = r.randrange(20), r.randrange(9, 16)
            part = [x.upper() if r.random() < 0.3 else x.replace("a", "á") for x in part[a : a + n]]
            w[10:10] = (r.choice((" ", ", ", " — ", "\n> "))).join(part).split(" ")
        docs.append((d, " ".join(w)))
    docs += [(90, None), (91, ""), (92, docs[1][1]), (93, "x " * 30_000 + items[3][1])]
    plain = {i: words.plain_words(t) for i, t in items}
    grams = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, w in plain.items() if grams(words.plain_words(t)) & grams(w)}
    frame = spark.createDataFrame([(*d, "e") for d in docs], "doc_id bigint, text string, item_id string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (leaks.BLOCK_WORDS, 90):
        got = leaks.find_leaks(frame, asked, block_words=block).where("run_words >= 12")
        assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    assert leaks.find_leaks(frame, asked.limit(0)).count() == 0 and leaks.find_leaks(frame.limit(0), asked).count() == 0
    w = plain[0][:30]
    w[7] = w[20] = "changed"
    tolerant = leaks.find_leaks(spark.createDataFrame([(1, " ".join(w))], "doc_id bigint, text string"), asked).where("item_id = 0").head()
    assert tolerant.overlap_words == 30 and tolerant.substituted == 2 and tolerant.run_words == 12


def test_longest_overlap_beside_a_longer_run():
    item = [f"w{k}" for k in range(60)]
    doc = ["x"] * 5 + item[:11] + ["y"] * 9 + item[20:30] + ["z"] + item[31:41] + ["x"] * 5
    index = leaks.ItemIndex([(1, item)])
    assert leaks.find_overlaps(index, " ".join(doc), 0.15) == [(1, 25, 20, 11, 21, 1)]
    r = random.Random(13)
    for _ in range(300):
        equal = np.array([r.random() < 0.8 for _ in range(r.randrange(1, 40))])
        want = max([j - i for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if equal[i] and equal[j - 1] and (~equal[i:j]).sum() <= 0.15 * (j - i) + 1e-9], default=0)
        assert leaks.tolerant_stretch(equal, 0.15)[0] == want


def test_mixture(spark):
    r = random.Random(7)
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 60))), r.choice(("A_x", "a-X ", "b", "B", "c", "other", None))) for i in range(800)] + [(900, None, "b"), (901, "", "c")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, copy int")
    targets = spark.createDataFrame([("a_x", 0.3, 2), ("b", 0.5, 3), ("c", 0.15, 4), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    out = mixing.mix(frame, targets, *plans._tokenizer())
    report = {x.source: x for x in mixing.share_report(out, targets).collect()}
    for s, share, most in (("a_x", 0.3, 2), ("b", 0.5, 3), ("c", 0.15, 4)):
        assert abs(report[s].actual_share - share / 0.95) < 0.01 and report[s].most_repeats <= most
    assert report["none"].tokens == 0
    rows = out.collect()
    assert [x.position for x in rows] == sorted(x.position for x in rows) and len({(x.doc_id, x.copy) for x in rows}) == len(rows)
    early = [x for x in rows if x.position < rows[-1].position / 2]
    share = lambda xs: sum(x.tokens for x in xs if x.source == "b") / sum(x.tokens for x in xs)
    assert share(early) < share(rows)  # the larger half of the shares comes later or earlier, as its tilt says
    assert mixing.mix(frame.limit(0), targets, *plans._tokenizer()).count() == 0


@pytest.fixture(scope="module")
def span_model():
    return trained_model(["Ambrose", "Maëlle", None, "Tobin"], 900)


def test_personal_held_out(span_model):
    right = found = there = 0
    for text, gold in labelled_texts(["Ambrose", "Maëlle", "Tobin"], 300, seed=77):
        got = {(s, e, t) for s, e, t, _ in span_model.decode(text)}
        right, found, there = right + len(got & gold), found + len(got), there + len(gold)
    assert right / found > 0.97 and right / there > 0.97


def test_decoding_is_the_best_set(span_model):
    text = "According to Ambrose K. Wexcombe, call 020 7946 0329. Applicant: passport no. X01610975."
    spans, fs = span_model.prepared(text)
    scores = span_model.scores((spans, fs))
    best = max(sum(scores[i] for i in range(len(spans)) if m >> i & 1) for m in range(1 << len(spans)) if all(spans[i][1] <= spans[j][0] or spans[j][1] <= spans[i][0] for i in range(len(spans)) for j in range(i) if m >> i & 1 and m >> j & 1))
    got = span_model.decode(text)
    assert abs(sum(scores[spans.index(s)] for s in got) - best) < 1e-9
    assert [text[s:e] for s, e, *_ in got] == ["Ambrose K. Wexcombe", "020 7946 0329", "X01610975"]
    assert span_model.redact(text) == "According to [NAME], call [PHONE]. Applicant: passport no. [ID]."


def test_personal_frames(spark, span_model):
    rows = [(1, "From: a.b@mail.ostrey.test and a.b@mail.ostrey.test", "k"), (2, None, "k"), (3, "", None), (4, "Node 192.0.2.56 answered. Range 570-00-2743 of the block list was skipped.", "k"), (1, "From: a.b@mail.ostrey.test", "k"), (5, "plain words " * 20_000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pii_type string")
    got = [tuple(r) for r in personal.extract(df, span_model).collect()]
    assert sorted(got) == [(1, "email", "a.b@mail.ostrey.test")] * 2
    out = {(r.doc_id, r.text) for r in personal.redact(df, span_model).collect()}
    assert (1, "From: [EMAIL] and [EMAIL]") in out and (2, None) in out and (3, "") in out
    assert personal.extract(df.limit(0), span_model).count() == 0


def test_pages():
    lines, tail = pages.html_lines("<p>a <a href=x>b</a><li>c</li><script>no</script><h1>{{x}} <%= y %></h1><p>open")
    assert [(x.tag, x.text) for x in lines] == [("p", "a b"), ("li", "c"), ("h1", "{{x}} <%= y %>"), ("p", "open")] and tail == "open"
    assert pages.site_label("http://www.copper-herald.example/x") == "copperherald" and pages.site_label(None) == ""
