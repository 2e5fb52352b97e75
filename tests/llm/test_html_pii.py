import re

from terrametro.llm import html, pii

KEY = b"test"


def text(source, path=None):
    return html.Page(source).main_text(path)


def test_page_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy</div>
    <article id=a1><h1>Head &amp; tail</h1><p><b>One<br>two <p>Three&nbsp; <i>fo</i>ur</p><!-- <p>no</p> -->
    <ul><li>a<li>b</ul><form><p>mail</p></form><table><tr><td>x<td>y</table><div class="post-comments"><p>first!</p></div></article>
    <aside>Side</aside><footer>&copy;</footer></body></html>"""
    assert text(page).split("\n\n") == ["Head & tail", "One two", "Three four", "a", "b", "x", "y"]
    assert text("") == "" and text("plain <b>only") == "plain only" and text("<p>cut <a hre") == "cut"
    assert text("<div><div><p>" * 3000 + "deep") == "deep"


def test_hosts_vote(spark):
    body = "<div class='story-{0}'><p>" + "long words here " * 20 + "</p></div>"
    pages = [(i, "https://h.example/x%d" % i, f"<body>{body.format(i)}<div class='box'><p>other</p></div></body>", "p") for i in range(5)]
    odd = "<body><div class='story-9'><p>short</p></div><div class='box'><p>" + "much other text " * 9 + "</p></div></body>"
    pages += [(9, "https://h.example/odd", odd, "p"), (10, None, odd, "p"), (11, "https://h.example/none", None, "p"), (11, "https://h.example/none", None, "p")]
    table = spark.createDataFrame(pages, "page_id int, url string, html string, path string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_texts(table).collect()}
    assert got[9] == ("short", 5) and got[10][0].startswith("much") and got[11] == ("", 0)
    assert all(got[i][0] == ("long words here " * 20).strip() for i in range(5))
    assert html.main_texts(table).count() == 9 and html.main_texts(table.limit(0)).count() == 0


def test_surrogates_keep_format():
    for kind, value in (("email", "ann.34@mail7.example.com"), ("phone", "+1 (017) 555-7713"), ("ip", "10.0.255.3"), ("card", "4111111111111111"),
                        ("card", "5927-2430-7427-3351"), ("secret", "04DBEBAB91AB85687D33"), ("ssn", "123-45-6789"), ("email", "анна@почта.рф")):
        drawn = pii.surrogate(KEY, kind, value)
        assert drawn != value and drawn == pii.surrogate(KEY, kind, value) and drawn != pii.surrogate(b"other", kind, value)
        assert kind == "ip" or re.sub(r"\d", "9", drawn).translate({}) and len(drawn) == len(value)
        assert pii.mentions(f"x token = {drawn} y" if kind == "secret" else f"x {drawn} y")[0][2:] == (kind, drawn)
    digits = [int(c) for c in pii.surrogate(KEY, "card", "4111111111111111")]
    assert digits[-1] == pii._check_digit(digits[:-1])
    images = {tuple(pii.permute(KEY, "x", [a, b, c], [10, 26, 3], 0)) for a in range(10) for b in range(26) for c in range(3)}
    assert len(images) == 780
    name = pii.surrogate(KEY, "name_f", "Erika Mustermann").split()
    assert name[0] in pii.GIVEN["f", "latin"].split() and len(name) == 2
    assert pii.mentions("mit Frau Erika Mustermann und г-н Иван Петров.") == [(9, 25, "name_f", "Erika Mustermann"), (34, 45, "name_m", "Иван Петров")]


def test_corpus_keeps_identity_and_distinctness(spark, monkeypatch):
    # Two-digit hosts are so few that surrogates collide with real ones.
    monkeypatch.setattr(pii, "_PATTERN", re.compile(r"(?P<ssn>\b\d\d\b)"))
    rows = [(i, f"a {i:02d} b {(i * 7) % 60:02d}", "k") for i in range(60)] + [(None, None, "k"), (5, "", "k"), (5, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(40)], "kind string, value string")
    again = {r.value: r.attempt for r in pii.redrawn(found, KEY).collect()}
    drawn = [pii.surrogate(KEY, "ssn", f"{i:02d}", again.get(f"{i:02d}", 0)) for i in range(40)]
    assert len(set(drawn)) == 40 and not set(drawn) & {f"{i:02d}" for i in range(40)}
    monkeypatch.undo()
    rows = [(1, "mail ann@x1.example.com, 10.1.2.3", "k"), (2, "ann@x1.example.com again; clean", "k"), (3, "nothing here", "k"), (None, None, "k"), (4, "", "k")]
    got = {r.doc_id: r for r in pii.replace_personal_data(spark.createDataFrame(rows, docs.schema), KEY).collect()}
    assert got[3].text == "nothing here" and got[None].text is None and got[4].n_entities == 0 and got[1].kinds == "email:1,ip:1"
    assert got[1].text.split()[1].rstrip(",") == got[2].text.split()[0] != "ann@x1.example.com"
    assert pii.replace_personal_data(docs.limit(0), KEY).count() == 0


def test_one_word_names_never_run_out(spark, monkeypatch):
    assert len({pii.surrogate(KEY, "name_m", "Ann", a) for a in range(300)}) == 300
    assert all(3 * n <= len(pii.surrogate(KEY, "name_m", "Meier", n - 4)) <= 4 * n for n in (4, 5, 9))
    # Attempts beyond a byte are written as they were settled.
    again = spark.createDataFrame([("name_m", "Meier", 300)], "kind string, value string, attempt int")
    monkeypatch.setattr(pii, "redrawn", lambda found, key: again)
    docs = spark.createDataFrame([(1, "Herr Meier")], "doc_id long, text string")
    assert pii.replace_personal_data(docs, KEY).first().text == "Herr " + pii.surrogate(KEY, "name_m", "Meier", 300)
    monkeypatch.undo()
    # More names than four syllables of two kinds make: 16.
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "den"])
    names = [f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    drawn = {n: pii.surrogate(KEY, "name_m", n, 4) for n in names}
    assert len(set(drawn.values())) > 16


def test_every_script_and_full_formats_have_surrogates(spark):
    """Brute force of distinctness and coreference; a format with all its 100 values in the corpus."""
    from terrametro.llm import pii

    values = ["用户@例子.公司", "é@ü.fr", "+٩٦٦ ٥٠ ١٢٣ ٤٥٦٧", *[f"{a}@{b}.5" for a in range(10) for b in range(10)]]
    rows = [(i, f"write to {v} or {v}") for i, v in enumerate(values)]
    out = pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()
    given = {}
    for r in out:
        one, two = r.text.removeprefix("write to ").split(" or ")
        assert one == two and values[r.doc_id] not in r.text
        given[values[r.doc_id]] = one
    assert len(given) == len(values) == len(set(given.values())) and not set(given.values()) & set(values)
    assert given["é@ü.fr"].endswith(".fr") and all("٠" <= c <= "٩" for c in given["+٩٦٦ ٥٠ ١٢٣ ٤٥٦٧"] if c.isdigit())
