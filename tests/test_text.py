"""Text, address, mailbox and display columns on hand-made values."""

import pytest
from pyspark.sql import functions as F

from hirelake.functions import display, mail, text, web
from hirelake.operators import messages, pages
from hirelake.rules import Rules
from hirelake.sources import scans


def values(spark, column, data, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i INT, v {kind}")
    return [r[1] for r in sorted(df.select("i", column.alias("out")).collect())]


def test_mailbox_form(spark):
    got = values(spark, mail.mailbox_ok("v"), [
        "user@example.com", "john.doe@sub.domain.co.in", "invalid-email", "@missing-user.com",
        "missing-domain@", "", None, "  user@example.com\t", "a b@example.com"])
    assert got == [True, True, False, False, False, False, False, True, False]


def test_mailbox_guesses(spark):
    got = values(spark, mail.mailbox_guesses("v", F.lit("Google.com ")), ["Jane Doe", "Jane", " ", "Ana Maria  Li", "Al Al"])
    assert got[0] == ["jane.doe@google.com", "jane@google.com", "j.doe@google.com",
                      "janedoe@google.com", "doe.jane@google.com", "careers@google.com"]
    assert got[1] == ["jane@google.com", "careers@google.com"]
    assert got[2] == ["careers@google.com"]
    assert got[3][0] == "ana.li@google.com"
    assert got[4] == ["al.al@google.com", "al@google.com", "a.al@google.com", "alal@google.com", "careers@google.com"]
    assert values(spark, mail.mailbox_guesses("v", F.lit("")), ["Jane Doe"]) == [[]]


def test_name_from_mailbox(spark):
    got = values(spark, mail.name_from_mailbox("v"), ["jane.doe@x.com", "j2b@x.com", "O'NEIL_jr@x.com", "hiring@x.com"])
    assert got == [n.split("@")[0].title() for n in ["jane.doe@", "j2b@", "O'NEIL_jr@", "hiring@"]]


def test_company_domain(spark):
    df = spark.createDataFrame([("Acme Corp", None), ("Acme Corp", ""), ("Acme", "a.io")], "n STRING, d STRING")
    assert [r[0] for r in df.select(mail.company_domain("d", "n")).collect()] == ["acmecorp.com", "acmecorp.com", "a.io"]


def test_redirects(spark):
    got = values(spark, web.redirect_target("v"), [
        "//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.example.com%2Fcareers&rut=123",
        "/l/?uddg=https%3A%2F%2Fwww.test.com%2Fjobs&rut=456",
        "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.valid-url.com&rut=789",
        "//example.com/no-redirect", " https://plain.example.com ", "/l/?uddg=https%3A%2F%2Fa.b%2Fx+y%zz"])
    assert got == ["https://www.example.com/careers", "https://www.test.com/jobs", "https://www.valid-url.com",
                   "https://example.com/no-redirect", "https://plain.example.com", "https%3A%2F%2Fa.b%2Fx+y%zz"]


def test_result_page(spark):
    block = ('<div class="links result__body"><a class="result__url" href="{h}">{t}</a>'
             '<a class="result__snippet">About <b>{t}</b></a></div>')
    html = "<html>" + block.format(h="/l/?uddg=https%3A%2F%2Fwww.test.com%2Fjobs&amp;rut=4", t="One") \
        + '<div class="result__body"><a class="result__url" href="//x.y/">no snippet</a></div>' \
        + block.format(h="//example.com/no-redirect", t="Two &amp; three") + "</html>"
    hits = pages.result_hits(spark.createDataFrame([(7, html)], "query_id INT, html STRING"))
    assert [tuple(r) for r in hits.orderBy("pos").collect()] == [
        (7, 0, "One", "https://www.test.com/jobs", "About One"),
        (7, 1, "Two & three", "https://example.com/no-redirect", "About Two & three")]


def test_placeholder_hits(spark):
    queries = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id INT, query STRING")
    hits = spark.createDataFrame([(2, 0, "t", "u", "s")], "query_id INT, pos INT, title STRING, url STRING, snippet STRING")
    got = {r["query_id"]: r["url"] for r in pages.with_placeholder_hits(queries, hits).collect()}
    assert got == {1: "https://example.com/search?q=a+b", 2: "u"}


def test_search_goes_from_engine_to_engine(spark):
    block = '<div class="result__body"><a class="result__url" href="{}">T</a><a class="result__snippet">s</a></div>'
    other = '<div><h3><a href="https://r.e.net/RU={}/RK=2">A <b>title</b></a></h3></div><p>says &amp; so</p>'
    first = [(1, "".join(block.format(f"https://a{i}.org/") for i in range(4))), (2, block.format("https://bad.org/x")), (3, ""), (4, "")]
    second = [(1, other.format("https%3A%2F%2Funseen.org")), (2, other.format("https%3A%2F%2Fb.org%2F") * 2 + other.format("https%3A%2F%2Fe.net%2Fad")),
              (3, other.format("https%3A%2F%2Fbad.org%2F")), (5, other.format("x"))]
    queries = spark.createDataFrame([(i, f"q {i}") for i in range(1, 5)], "query_id INT, query STRING")
    denied = spark.createDataFrame([("bad.org",)], "domain STRING")
    got = pages.search_results(queries, *[spark.createDataFrame(p, "query_id INT, html STRING") for p in (first, second)], denied, ["e.net"], 3)
    got = sorted(tuple(r) for r in got.where("query_id < 5").collect())
    assert got[:4] == [*[(1, i, "T", f"https://a{i}.org/", "s") for i in range(3)], (2, 0, "A title", "https://b.org/", "says & so")]
    assert [(r[0], r[1], r[3]) for r in got[4:]] == [(i, 0, f"https://example.com/search?q=q+{i}") for i in (3, 4)]


def test_url_domain(spark):
    got = values(spark, web.url_domain("v"), [
        "https://www.Example.com/a?b", "http://user:pw@host:8080/x", "//cdn.x.org/y", "mailto:a@b", "", None,
        "http://[bad/x", "https://a.b|c/d", "no-scheme.com/x"])
    assert got == ["example.com", "user:pw@host:8080", "cdn.x.org", "", "", "", "", "a.b|c", ""]


def test_bare_domain(spark):
    got = values(spark, web.bare_domain("v"), [" HTTPS://A.com/x/y ", "b.COM", "http://c.org"])
    assert got == ["a.com", "b.com", "c.org"]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p><b>no</b>";</script></head>
<body><header>top</header><nav><ul><li>menu</li></ul></nav><!-- gone --><h1> Head  line </h1>
<p>a &lt; b &#65;&#x42; &amp;lt; &euro;5&nbsp;&nbsp;x</p> single space\tkept <b>bold</b>tail<footer>foot</footer></body></html>"""
PAGE_TEXT = "T & U\nHead\nline\na < b AB &lt; €5\xa0\xa0x\nsingle space\tkept\nbold\ntail"


def test_page_text_native_and_parsed(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id INT, html STRING")
    native = {r[0]: r[2] for r in pages.page_text(df).collect()}
    parsed = {r[0]: r[1] for r in pages.page_text_parsed(df).collect()}
    assert native == {1: PAGE_TEXT, 2: "", 3: ""}
    assert parsed == native


REFERENCES = ["?x=1&lang=en&order=2&sub=3", "&alpha beta", "&copy2024", "&notit;", "&notin;", "&amp;lt;", "&amp&semi;", "a & b &; &", "&lt&gt;",
              "&eacute;t&eacute", "&frac123", "&NotEqualTilde;", "&unknown;&#65;&#x42&#0;&#128;&#xD800;&#99999999;", "&copy=2", "", "&am"]


def test_references_as_the_standard_says(spark):
    import html

    assert values(spark, web.decode_entities(F.col("v")), REFERENCES) == [html.unescape(t) for t in REFERENCES]
    got = values(spark, web.decode_entities(F.col("v"), attribute=True), [
        "?x=1&lang=en&order=2&sub=3", "?a=1&copy=2&copyright=3&copy", "?a&amp;b&amp=c", "&notit;", "&not;&not", None])
    assert got == ["?x=1&lang=en&order=2&sub=3", "?a=1&copy=2&copyright=3\u00a9", "?a&b&amp=c", "&notit;", "\u00ac\u00ac", None]


def test_links_keep_their_parameters(spark):
    df = spark.createDataFrame([(1, '<a href="/q?x=1&lang=en&amp;copy=2&order=3">&lang;a&copy2024</a>')], "page_id INT, html STRING")
    assert tuple(pages.page_links(df).first()) == (1, 0, "/q?x=1&lang=en&copy=2&order=3", "\u27e8a\u00a92024")


def test_clean_lines_matches_the_definition(spark):
    def plain(s):
        parts = (p.strip() for line in (x.strip() for x in s.splitlines()) for p in line.split("  "))
        return "\n".join(p for p in parts if p)

    samples = [" a  b ", "a\t \t  b", "a \n\n b", "x y\tz", "   ", "a\r\nb", "a   b    c", "\t a\t\n\tb  ", "a \t b", "é  ü\n"]
    assert values(spark, text.clean_lines(F.col("v")), samples) == [plain(s) for s in samples]


@pytest.mark.parametrize("terms", [("Bad",), tuple(f"t{i}x" for i in range(60)) + ("bad",), ()])
def test_contains_any(spark, terms):
    got = values(spark, text.contains_any("v", terms), ["A BAD name", "good", None])
    assert got == [bool(terms), False, False]


def test_display(spark):
    assert values(spark, display.stage_percent("v"), [0, 3, 12, 13], "INT") == [0, 25, 100, 100]
    assert values(spark, display.stage_label("v", F.lit("odd")), [3, 99], "INT") == ["Company Research", "odd"]
    assert values(spark, display.score_or_null("v"), [0.0, 8.514, None], "DOUBLE") == [None, 8.51, None]
    assert values(spark, display.score_shown("v"), [0.0, None], "DOUBLE") == [0.0, None]
    now = "2024-01-02 12:00:00"
    got = values(spark, display.age_of_text("v", now), [
        "2024-01-02 11:59:30", "2024-01-02 11:30:00.5", "2024-01-02 02:00:00", "2023-12-30 11:00:00", "soon", "2024-01-03 00:00:00"])
    assert got == ["Just now", "30m ago", "10h ago", "3d ago", "soon", "Just now"]
    assert values(spark, display.body_preview("v"), ["ab", "x" * 400, "", None]) == ["ab...", "x" * 300 + "...", None, None]
    ts = spark.createDataFrame([("2024-01-02 03:04:05",)], "v STRING").select(F.col("v").cast("timestamp").alias("v"))
    row = ts.select(*[scans.stamp("v", s).alias(s) for s in ("seconds", "file", "day")]).first()
    assert tuple(row) == ("2024-01-02 03:04:05", "20240102_030405", "20240102")


def test_render_does_not_rescan_values(spark):
    df = spark.createDataFrame([("{b}", "B")], "a STRING, b STRING")
    got = df.select(messages.render("x {a} y {b}", {"a": F.col("a"), "b": F.col("b")})).first()[0]
    assert got == "x {b} y B"


def test_signature(spark):
    rules = Rules(sender_name="Jane", linkedin_url="https://l.in/j", github_url="http://g.it/j")
    mark = '<br><a href="https://l.in/j">l.in/j</a> | <a href="http://g.it/j">g.it/j</a>'
    got = values(spark, messages.sign("v", rules), ["Hi Jane, Jane", "Hi", "see http://g.it/j Jane"])
    assert got == [f"Hi Jane{mark}, Jane", f"Hi<p>{mark}</p>", "see http://g.it/j Jane"]
    assert values(spark, messages.sign("v", Rules()), ["Hi"]) == ["Hi"]


def test_placeholders_and_keywords(spark):
    got = values(spark, messages.placeholder_errors("v"), ["Hi [Insert Name]", "at <Company> {role}", "fine [1]", "in YYYY", None])
    assert got == [["bracket placeholder"], ["tag placeholder", "brace placeholder"], [], ["date placeholder"], []]
    words = values(spark, messages.keywords_text("v", "software development"), [["a", "b"], [], None], "ARRAY<STRING>")
    assert words == ["a, b", "software development", "software development"]
    extra = values(spark, messages.unsupported("v", F.array(F.lit("Python"))), [["python", "Rust"], [], None], "ARRAY<STRING>")
    assert extra == [["rust"], [], []]


def test_pasted_key(spark):
    import hashlib
    want = "pasted://acme_corp_" + hashlib.md5("jd ü".encode()).hexdigest()[:8]
    assert values(spark, messages.pasted_key(F.lit("Acme Corp"), "v"), ["jd ü"]) == [want]


def test_rules():
    config = {
        "job_preferences": {"roles": ["Dev"], "geographies": ["Remote"], "experience_years_max": 1,
                            "allow_speculative_outreach": True},
        "exclusions": {"companies": ["X"], "keywords": ["Unpaid"]},
        "pipeline": {"daily_draft_limit": 20, "cache_lifetime_seconds": 60},
        "scoring": {"weights": dict.fromkeys(Rules.COMPONENTS, 0.5), "thresholds": {"minimum_score": 0.6}}}
    rules = Rules.from_mapping(config)
    assert rules.preferred_role == "Dev" and rules.daily_draft_limit == 20
    with pytest.raises(KeyError):
        Rules.from_mapping({})
    with pytest.raises(ValueError):
        Rules(weights={"role_match": 1.0})


def test_rule_table(spark):
    table = Rules(excluded_companies=("A", "B")).as_table(spark)
    assert table.where("rule = 'excluded_companies'").count() == 2


def test_page_text_of_unusual_markup(spark):
    cases = {
        "caf&eacute; &#146;&#150; &#x0000041; &unknown; &amp;lt; &amp a&b &#0; &#99999999;": "caf\u00e9 \u2019\u2013 A &unknown; &lt; & a&b \ufffd \ufffd",
        "a<nav>x<nav>y</nav>z</nav>b": "a\nb", "a<nav>never closed <p>c": "a", "a</nav>b": "a\nb",
        "<header><nav>q</header>r<NAV/>s": "r\ns", "<navigator>t</navigator>": "t", "\u3000a\u3000\n b": "a\nb"}
    df = spark.createDataFrame(list(enumerate(cases)), "page_id INT, html STRING")
    assert [r["text"] for r in pages.page_text(df).orderBy("page_id").collect()] == list(cases.values())


def test_links_with_any_quotes(spark):
    html = "<a href='x&amp;y'>T</a> <a class=z href=bare>B <b>c</b></a><a data-href=\"no\" href=\"d\">D</a>"
    got = spark.createDataFrame([(html,)], "h STRING").select(web.anchors("h").alias("a")).first()["a"]
    assert [(x["href"], x["title"]) for x in got] == [("x&y", "T"), ("bare", "B c"), ("d", "D")]
