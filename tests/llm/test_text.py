import re
import time
from datetime import date

from pyspark.sql import functions as F

from quillmap.llm import chat, html_text, langid, pii


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def run_pii(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_found) for r in pii.pseudonymise(df, **more).orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_and_validity(spark):
    card, out = "4845168114407329", {}
    texts = [f"a {card} b", f"{card[:4]}-{card[4:8]} {card[8:12]} {card[12:]}", "7536784127813050", "97.51.17.173", "999.1.1.1", "1.2.3.4.5", "+1 (017) 555-7713", "born 1999-12-31.", "31.12.1999", "12/31/1999", "1/2/2003", "1999-13-31", "ssn 123-45-6789", "000-45-6789", "a.b+34@mail7.example.com,", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "version 4.0, 12 items in 2024", "", None]
    for t, r in zip(texts, run_pii(spark, texts), strict=True):
        out[t] = r
    new = re.search(r"\d{16}", out[texts[0]][0])[0]
    assert luhn(new) and new != card and re.sub(r"\D", "", out[texts[1]][0]) == new and out[texts[1]][0][4] == "-"
    for same in (texts[2], texts[4], texts[5], texts[11], texts[13], texts[16], "", None):
        assert out[same] == (same, 0), same
    ip = out["97.51.17.173"][0].split(".")
    assert len(ip) == 4 and all(int(p) <= 255 for p in ip) and out["97.51.17.173"][1] == 1
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[texts[6]][0]) and out[texts[6]][0] != texts[6]
    iso = re.search(r"\d{4}-\d\d-\d\d", out[texts[7]][0])[0]
    moved = date.fromisoformat(iso)
    assert moved != date(1999, 12, 31) and out["31.12.1999"][0] == moved.strftime("%d.%m.%Y") and out["12/31/1999"][0] == moved.strftime("%m/%d/%Y")
    assert re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}", out["1/2/2003"][0])
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", out[texts[12]][0])
    assert re.fullmatch(r"[a-z]\.[a-z]\+\d\d@mail7\.example\.com,", out[texts[14]][0]) and texts[14] != out[texts[14]][0]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[texts[15]][0]) and not set(zip(out[texts[15]][0][9:49], texts[15][9:49], strict=True)) & {(c, c) for c in "0123456789abcdef"}
    assert run_pii(spark, ["the key: internationalisierungswort"])[0][1] == 0


def test_equal_values_stay_linked_and_keys_differ(spark):
    a, b = run_pii(spark, ["x 97.51.17.173 y", "97.51.17.173"])
    assert a[0][2:-2] == b[0]
    assert run_pii(spark, ["97.51.17.173"], key="other")[0][0] != b[0]


def test_digit_permutation_is_a_bijection_and_inverts(spark):
    for n in (2, 3, 4):
        s = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("s"))
        p = s.select("s", pii.permute_digits(F.col("s"), "k", "t").alias("p")).withColumn("back", pii.permute_digits(F.col("p"), "k", "t", inverse=True))
        assert p.where("back != s").count() == 0 and p.select("p").distinct().count() == 10**n


def test_dates_are_permuted(spark):
    days = spark.range(3000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    out = days.select(pii._moved(pii._day(F.col("d")), "k").alias("m"))
    assert out.distinct().count() == 3000 and out.where("m < '1900-01-01' or m > '2099-12-31'").count() == 0


def test_pii_frame_cases(spark):
    df = spark.createDataFrame([(None, "97.51.17.173", "c"), (1, "97.51.17.173", "c"), (1, "97.51.17.173", "c")], "doc_id long, text string, n_found string")
    got = pii.pseudonymise(df)
    assert got.columns == ["doc_id", "text", "n_found"] and got.select("text", "n_found").distinct().count() == 1
    assert pii.pseudonymise(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, ok, yes.</div><div id="wrap"><div class="content"><h2>Head &amp; line</h2><p>Para  one,\nwith, commas, and enough text to count as a paragraph.</p><div class=ad-box><p>Buy, buy, buy</p></div>
<ul><li>a &lt; b</li><li>two</li></ul><p><b>Second&nbsp;para<br>x<p>third, unclosed</div><div class="sidebar"><a href=x>l1</a></div></div>
<section class="comments"><p>reader, says, things, that, are, long, long, long</p></section><form><input name=q>Search</form><footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nPara one, with, commas, and enough text to count as a paragraph.\na < b\ntwo\nSecond para x\nthird, unclosed"
    assert html_text.main_text("<p>" * 5000 + "deep") == "deep"
    assert html_text.main_text("just text & <b>more") == "just text & more"
    for empty in ("", None, "<script>x", "<!-- <p>no</p>", "<nav>a</nav>"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text('<article><p title="a > b">kept</p></article>') == "kept"


def test_pii_long_secrets_and_the_session_key(spark):
    secret = "x" * 70 + "1"
    texts = [f"key: {secret}", "born 1987-03-12"]
    first = run_pii(spark, texts)
    spark.conf.set(pii.KEY_SETTING, "another key")
    try:
        second = run_pii(spark, texts)
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert all(a != b != t for a, b, t in zip(map(str, first), map(str, second), texts, strict=True)) and secret not in str(first)


LONG = "A paragraph, of some length, with commas, that goes on and on, so that it counts for much. " * 4


def test_html_keeps_the_whole_article():
    main = html_text.main_text
    eight, long = "".join(f"<p>{k} {LONG}</p>" for k in range(8)), [f"{k} {LONG}".strip() for k in range(8)]
    epilogue = "<section><h2>Epilogue</h2><p>Short, the end.</p></section>"
    whole = "\n".join(["Title", *long, "Epilogue", "Short, the end."])
    assert main(f"<body><nav><a>x</a></nav><article><h1>Title</h1><section>{eight}</section>{epilogue}</article><footer>f</footer></body>") == whole
    assert main(f"<div class=wrap><div><div><h1>Title</h1><section>{eight}</section>{epilogue}</div></div><div class=sidebar>s</div></div>") == whole
    deep = lambda x: "<div>" * 6 + x + "</div>" * 6
    assert main(f"<body>{deep(eight)}{deep('<p>Second part, short.</p>')}</body>") == "\n".join([*long, "Second part, short."])
    assert main(f"<body><h1>Title</h1>{eight}loose words<p>Short.</p></body>") == "\n".join(["Title", *long, "loose words", "Short."])
    assert main("<article><p>An <math><mi>x</mi></math> inside, ok.</p></article>") == "An x inside, ok."
    assert main(f"<article>{eight}<div class='notice-board'><p>Kept, too.</p></div><div class='site-notice'>gone</div><div class='notice-bar'>gone</div></article>") == "\n".join([*long, "Kept, too."])
    menu = "<ul>" + "".join(f"<li><a href=/{k}>entry {k}</a></li>" for k in range(9)) + "</ul>"
    assert main(f"<body>{menu}<div>{menu}{eight}</div><div>{menu}</div></body>") == "\n".join(long)
    assert main(f"<article>{eight}</article><div><p>About, us, all, else.</p></div><article><p>Another article, here.</p></article>") == "\n".join([*long, "Another article, here."])


def test_html_words_in_names_do_not_decide_on_text():
    main = html_text.main_text
    eight, long = "".join(f"<p>{k} {LONG}</p>" for k in range(8)), [f"{k} {LONG}".strip() for k in range(8)]
    part = lambda name: f"<section class='{name}'><h2>Part</h2><p>It has some words of its own.</p></section>"
    for name in ("discussion", "text-widget", "map-overlay", "market-share", "how-to-login", "tasting-menu", "election-banner", "ocean-side"):
        want = "\n".join([*long, "Part", "It has some words of its own."])
        assert main(f"<body><article>{eight}{part(name)}</article></body>") == want, name
        assert main(f"<body><div id=content>{eight}{part(name)}</div></body>") == want, name
    for name in ("share", "login-box", "social-share", "newsletter-overlay", "cookie-banner", "site-menu", "user-responses", "reader-discussion", "comments", "ad-widget", "signup-modal"):
        assert main(f"<article>{eight}{part(name)}</article>") == "\n".join(long), name
        assert main(f"<body><div>{eight}{part(name)}</div></body>") == "\n".join(long), name
    links = "".join(f"<a href=/{k}>Entry {k}.</a>" for k in range(5))
    assert main(f"<article>{eight}<div class='market-share'><p>{links}</p></div></article>") == "\n".join(long)
    assert main(f"<article>{eight}<div class='how-to-login'><p>Give your name and word here.</p><input name=q></div></article>") == "\n".join(long)


def test_html_controls_headers_and_references():
    main = html_text.main_text
    eight, long = "".join(f"<p>{k} {LONG}</p>" for k in range(8)), [f"{k} {LONG}".strip() for k in range(8)]
    assert main("<article><p>See <label>this word</label> and <output>42</output>, press <button>Go</button> now.</p><div><button>Share</button> <label>x</label></div></article>") == "See this word and 42, press Go now."
    assert main(f"<body><header><h1>Site</h1></header><div id=content><header><h1>Title</h1><p>By someone.</p></header>{eight}</div></body>") == "\n".join(["Title", "By someone.", *long])
    assert main(f"<body><div id=wrap><header class=entry-header><h1>Title</h1></header>{eight}</div></body>") == "\n".join(["Title", *long])
    assert main(f"<body><div id=wrap><header><h1>Site</h1></header><div>{eight}</div></div></body>") == "\n".join(long)
    items = "<ul>" + "".join(f"<li><a href=/{k}>Author {k}</a></li>" for k in range(3)) + "</ul>"
    listed = ["Author 0", "Author 1", "Author 2"]
    assert main(f"<body><div>{eight}<h2>References</h2>{items}</div></body>") == "\n".join([*long, "References", *listed])
    assert main(f"<body><div>{eight}<p>They are:</p>{items}</div></body>") == "\n".join([*long, "They are:", *listed])
    assert main(f"<body><div>{eight}<h2>Related pages</h2>{items}</div></body>") == "\n".join(long)


def test_html_takes_time_in_proportion():
    n = 30_000
    for page in ("<a " * n, "<b>" * n + "</x>" * n, "<li><div>" + "<b>" * n + "</li>" * n, "<b>" * n + "<p>" * n, "<a =\"" * n + ">", "<audio>" * n, "<" * n, "<p>x</p>" * n, "<div>" * n + "x", "<!--" * n, "<a b='" * n, "<ul><li>" * n + "</ul>" * n):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 3, page[:20]


def test_html_of_the_table_is_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    from html import unescape

    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[p.page_id].text == "\n".join(x for x in parts if x) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_html_frame_cases(spark):
    df = spark.createDataFrame([(1, "u", None, "c"), (None, None, PAGE, "c"), (1, "u", None, "c")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract(df).collect()) == [0, 0, len(html_text.main_text(PAGE))]
    assert html_text.extract(df.limit(0)).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs.select("doc_id", "text", "lang")).withColumn("held", langid.held_out("doc_id"))
    held = got.where("held").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in held) and sum(r.rejected for r in held) <= 0.01 * len(held)


def test_language_cases(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in ((f"the cat and the dog number {k} sat on the mat", "en"), (f"der hund und die katze sitzen auf der matte {k}", "de"))]
    rows = [(i, t, lang, "x") for i, (_, t, lang) in enumerate(rows)] + [(900, None, "en", "x"), (901, "123 !!", "en", "x"), (902, "", None, "x"), (None, "the cat", None, "x"), (903, "語語語語", None, "x"), (904, "the dog " * 30_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (900, 901, 902))
    assert got[None].lang_pred == "en" and got[904].lang_pred == "en" and got[903].rejected and got[903].lang_pred in ("de", "en")
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", None), (1, 70, "cat", "late"), (2, 0, "system", "alone"), (3, None, None, "x"), (1, 1, "ann", "hi"), (None, 1, "ann", "a"), (None, 1, "ann", "a")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, participant string")
    rows = chat.rotate(df).collect()
    got = {(r.conv_id, r.participant, r.segment): r for r in rows}
    assert set(got) == {(1, p, s) for p in ("ann", "bob", "cat") for s in (0, 1)} | {(3, "unknown", 0), (None, "ann", 0)}
    a = got[1, "ann", 0]
    assert a.text == "<|system|>\nbe kind<|end|>\n" + "<|assistant|>\nhi<|end|>\n" * 2 + "<|user:bob|>\nhé<|end|>\n<|assistant|>\n<|end|>\n"
    assert [a.text[s.start : s.end] for s in a.spans] == ["hi<|end|>", "hi<|end|>", "<|end|>"] and (a.n_messages, a.n_trained, a.continued) == (5, 3, False)
    # A later segment opens with the system message, and messages without a conversation stand alone.
    c = got[1, "cat", 1]
    assert got[1, "cat", 0].spans == [] and [c.text[s.start : s.end] for s in c.spans] == ["late<|end|>"]
    assert c.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nlate<|end|>\n" and (c.n_messages, c.n_trained, c.continued) == (1, 1, True)
    assert [r.text for r in rows if r.conv_id is None] == ["<|assistant|>\na<|end|>\n"] * 2
    assert chat.rotate(df.limit(0)).count() == 0
