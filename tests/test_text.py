from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import facts, markup
from gleaner.functions import text as X
from gleaner.functions.splitter import chunks, split_text
from gleaner.operators import citations as C
from gleaner.operators.sessions import short_title
from gleaner.sources import contracts


def values(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


# --- chunks -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "lengths"),
    [
        ("", []),
        (" \n\t ", []),
        ("x" * 799, [799]),
        ("x" * 800, [800]),
        ("x" * 801, [800, 121]),
        ("a" * 2500, [800, 800, 800, 460]),
    ],
)
def test_chunk_lengths(text, lengths):
    assert [len(c) for _, c in split_text(text)] == lengths


def test_paragraphs_stay_apart_when_they_do_not_fit():
    text = "a" * 500 + "\n\n" + "b" * 500
    assert split_text(text) == [(0, "a" * 500), (502, "b" * 500)]


def test_short_paragraph_is_carried_over():
    # The 100-character paragraph fits the overlap, so it opens the next chunk too.
    text = "a" * 500 + "\n\n" + "b" * 98 + "\n\n" + "c" * 400
    found = split_text(text)
    assert [s for s, _ in found] == [0, 502]
    assert found[0][1].endswith("b" * 98) and found[1][1].startswith("b" * 98)


def test_long_line_between_short_ones_is_cut_alone():
    text = "head\n" + "w " * 600 + "\ntail"
    found = split_text(text)
    assert found[0] == (0, "head")
    assert found[-1][1].endswith("tail")
    assert all(len(c) <= 800 for _, c in found)


def test_words_overlap():
    found = split_text("word " * 400)
    assert [len(c) for _, c in found] == [799, 799, 639]
    assert found[1][0] == 680


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunks_fit_sit_and_cover(text, size, overlap):
    found = split_text(text, size, overlap)
    covered = set()
    for start, body in found:
        assert 0 < len(body) <= size
        assert text[start : start + len(body)] == body
        assert body == body.strip()
        covered.update(range(start, start + len(body)))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_arrow_function_equals_plain(spark):
    texts = ["", None, "a" * 2500, "Zeile eins\nZwei " * 90, "ü " * 700]
    got = values(spark, texts, "t string", chunks("t"))
    assert [[(r["start"], r["chunk"]) for r in row] for row in got] == [split_text(t) for t in texts]


# --- names and urls ---------------------------------------------------------


def test_normalize_url(spark):
    cases = {
        "http://a/b?utm_source=x": "http://a/b",
        "http://a/b?q=1&utm_source=x&r=2": "http://a/b?q=1&r=2",
        "x/?utm_a=1&q=2": "x/&q=2",
        "http://a/b?GCLID=9": "http://a/b",
        "http://a/b?gclid=": "http://a/b?gclid=",
        "\t http://a/ \n": "http://a",
        "http://a//": "http://a/",
        "": "",
    }
    assert values(spark, list(cases), "u string", X.normalize_url("u")) == list(cases.values())


def test_split_urls(spark):
    assert values(spark, ["a, b\nc,,\r\n d "], "t string", X.split_urls("t")) == [["a", "b", "c", "d"]]


def test_table_names(spark):
    cases = {
        "/x/My File (1).csv": "my_file_1",
        "plain": "plain",
        "/x/.csv": "csv",
        "/x/--.csv": "table_1",
        "a.b.CSV": "a_b",
        "__x__.xlsx": "x",
    }
    assert values(spark, list(cases), "p string", X.table_name("p")) == list(cases.values())
    assert values(spark, ["/d/My File.v2.csv"], "p string", X.table_name_plain("p")) == ["my_file.v2"]


def test_file_kinds(spark):
    paths = ["a.PDF", "b.tiff", "c.xls", "d.csv", "noext", "x.gif"]
    assert values(spark, paths, "p string", X.file_kind("p")) == ["pdf", "unsupported", "unsupported", "table", "unsupported", "image"]
    assert values(spark, paths, "p string", X.file_kind("p", wide=True)) == ["unsupported", "image", "table", "table", "unsupported", "image"]


def test_statement_class(spark):
    cases = {"select 1": True, " SELECT": True, "selection of": True, "explain why": True, "what is": False, "": False, None: False}
    assert values(spark, list(cases), "q string", X.looks_like_sql("q")) == list(cases.values())


def test_previews(spark):
    text = " a\nb" + "x" * 300
    assert values(spark, [text], "t string", X.preview("t")) == [("a b" + "x" * 300)[:219]]
    assert values(spark, [text], "t string", X.ocr_preview("t")) == [(" a b" + "x" * 300)[:140]]


def test_unescape(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#65;&#x20ac;&nope;&": "A€&nope;&", "x&nbsp;y": "x\xa0y", "plain": "plain"}
    assert values(spark, list(cases), "t string", markup.unescape(F.col("t"))) == list(cases.values())


def test_a_repeat_does_not_take_another_page_of_its_position_along(spark):
    rows = [(1, "http://a/x", "<p>one</p>"), (2, "http://a/x", "<p>again</p>"), (2, "http://b/y", "<p>two</p>")]
    got = contracts.pages(spark.createDataFrame(rows, "page_id long, url string, html string")).select("source", "text").collect()
    assert sorted(r["text"] for r in got) == ["one", "two"] and len({r["source"] for r in got}) == 2


def test_repeated_and_unnumbered_pages_stay_once(spark):
    rows = [(1, "http://a", "<p>a</p>"), (1, "http://a", "<p>a</p>"), (None, "http://b", "<p>later</p>"), (None, "http://b/", "<p>first</p>"), (None, "http://a", "<p>no</p>")]
    rows += [(3, "http://c?utm_source=x", None), (3, "http://c", "<p>c</p>"), (None, None, "<p>x</p>"), (4, " ", "<p>x</p>")] + [(9, "http://hot", f"<p>{i % 3}</p>") for i in range(50)]
    got = contracts.pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("source", F.lit("own"))).select("source", "text").collect()
    assert sorted((r["source"], r["text"]) for r in got if r["text"] is not None) == [("http://a", "a"), ("http://b", "first"), ("http://hot", "0")]
    assert [r["source"] for r in got].count("http://c") == 1


def test_page_text(spark):
    page = "<html lang='de'><head><title>T &amp; U</title><script>if (a<b) x()</script></head><!-- <b>no</b> --><p>1 < 2</p></html>"
    html = F.col("h")
    assert values(spark, [page], "h string", F.struct(markup.page_text(html), markup.page_title(html), markup.page_language(html))) == [
        ("T & U1 < 2", "T & U", "de")
    ]


# --- facts ------------------------------------------------------------------

FACT_CASES = [
    ("Data & AI Summit 2025", "event_name", "Data & AI Summit 2025"),
    ("Jun 12–14, 2025", "event_dates", "Jun 12–14, 2025"),
    ("april 14 to 16, 2025", "event_dates", "april 14 to 16, 2025"),
    ("it shall be fine\nx", "venue", "hall be fine"),
    ("Opening Keynote at 9:00 AM - 10:30 AM", "keynote_time", "9:00 AM - 10:30 AM"),
    ("Keynote: “The Future”", "keynote_title", "The Future"),
    ('he said "so"', "keynote_title", "so"),
    ("nearby New York", "keynote_speaker", "New York"),
    ("Keynote by Ada Lovelace\nTickets here", "keynote_speaker", "Ada Lovelace\nTickets"),
    ("Early-bird: 20% off if bought, ends March 1, 2025", "early_bird", "20% off; ends March 1, 2025"),
    ("Standard 299", "price_standard", "99"),
    ("Standard $299", "price_standard", "299"),
    ("Workshops $75", "price_workshop", "75"),
    ("Expo 10:00 - 18:00 EACH DAY", "expo_hours", "10:00–18:00 daily"),
    ("Exhibition from 9:30–17:00", "expo_hours", "9:30–17:00"),
    ("Invoice Notes", "invoice_number", "tes"),
    ("Invoice #: A-17", "invoice_number", "A-17"),
    ("Warranty: 02 Years", "warranty", "2 years"),
    ("Warranty: 02 Years", "warranty_months", "24"),
    ("guarantee 1 month", "warranty", "1 month"),
    ("guarantee 18 months", "warranty_months", "18"),
    ("Warranty period: 2 years", "warranty", None),
    ("nothing here", "event_name", None),
]


def test_facts(spark):
    found = values(spark, [c[0] for c in FACT_CASES], "t string", facts.extract_facts(F.col("t")))
    assert [row[case[1]] for row, case in zip(found, FACT_CASES)] == [case[2] for case in FACT_CASES]


def test_direct_answers(spark):
    text = "Data Summit 2025\nStandard $299\nInvoice No: 7\nWarranty 2 years\nKeynote: “Go”"
    cases = {
        "What is the event name?": "Data Summit 2025",
        "standard price": "$299",
        "invoice number": "7",
        "do you know the invoice": "7",
        "warranty in months": "24 months",
        "warranty": "2 years",
        "keynote title": "“Go”",
        "venue": None,
    }
    rows = [(q, text) for q in cases]
    answer = facts.direct_answer(F.col("q"), facts.fact_columns(F.col("t")))
    assert values(spark, rows, "q string, t string", answer) == list(cases.values())


# --- cites ------------------------------------------------------------------


def test_cited_numbers(spark):
    cases = ["[2] and [1][2] [9] [0]", "none", "[99999999999999]", None]
    assert values(spark, cases, "t string", C.cited_numbers(F.col("t"), F.lit(5))) == [[1, 2], [], [], []]


def test_parse_sources(spark):
    cases = {
        "x\n\nSources:\n[1] /a/b (ti_pdfs)\n- [3] http://c  (ti_urls) \n\n* [4] d\nstop\n[5] e": [(1, "/a/b"), (3, "http://c"), (4, "d")],
        "x\nSOURCES:  \n[1] a\nType your question\n[2] b": [(1, "a")],
        "x Sources: no": [],
        "Sources:\n": [],
        "": [],
    }
    got = values(spark, list(cases), "t string", C.parse_sources(F.col("t")))
    assert [[tuple(r) for r in row] for row in got] == list(cases.values())


CITE = "array<struct<n:int,id:string,collection:string,source:string,preview:string,distance:double>>"


def test_used_cites_and_block(spark):
    cites = [(1, "a", "ti_urls", "s1", "p", 0.1), (2, "b", "ti_pdfs", "s2", "p", 0.2), (3, "c", "ti_pdfs", "", "p", 0.3)]
    rows = [("see [3] and [2]", cites), ("nothing", cites)]
    used = C.used_cites(F.col("t"), F.col("c"))
    assert [[c["n"] for c in row] for row in values(spark, rows, f"t string, c {CITE}", used)] == [[2, 3], [1]]
    block = values(spark, rows, f"t string, c {CITE}", C.sources_block(used))
    assert block[0] == "\n\nSources:\n[1] s2 (ti_pdfs)\n[2]  (ti_pdfs)"
    kept = values(spark, rows, f"t string, c {CITE}", C.sources_block(used, renumber=False))
    assert kept[0] == "\n\nSources:\n[2] s2 (ti_pdfs)\n[3]  (ti_pdfs)"


def test_dedupe_keeps_first_and_falls_back_to_id(spark):
    cites = [(1, "a", "x", "s", "", 0.1), (2, "b", "x", "", "", 0.2), (3, "c", "x", "s", "", 0.3), (4, "d", "x", "", "", 0.4)]
    got = values(spark, [(cites,)], f"c {CITE}", C.dedupe_by_source(F.col("c")))
    assert [c["id"] for c in got[0]] == ["a", "b", "d"]


@pytest.mark.parametrize(("length", "cut"), [(44, False), (45, False), (46, True)])
def test_titles(spark, length, cut):
    text = "t" * length
    assert values(spark, [text], "t string", short_title(F.col("t"))) == [text[:44] + "…" if cut else text]


def test_session_titles(spark):
    from gleaner.operators.sessions import session_titles, turn_pairs

    rows = [(1, 0, "system", "s"), (1, 1, "user", "  "), (1, 2, "assistant", "hm"), (1, 3, "user", " hello "), (2, 0, "user", " ")]
    pairs = turn_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 1, "  ", "hm"), (1, 3, " hello ", None), (2, 0, " ", None)]
    when = F.lit(datetime(2024, 1, 2, 3, 4, 5)).cast("timestamp_ntz")
    got = {r["conv_id"]: (r["title"], r["n_pairs"]) for r in session_titles(pairs, when).collect()}
    assert got == {1: ("2024-01-02 03:04 · hello", 2), 2: ("2024-01-02 03:04 · Untitled", 1)}
