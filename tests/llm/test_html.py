from shelfmark.llm.html_text import extract, render

PAGE = (
    "<html><head><title>T</title><style>x</style><body><h1>Head</h1><p>One <b>two</b><p>Three &amp; four<br>five<ul><li>a<li>b<ol><li>c</ol></ul>"
    "<table><tr><td>x<td>long cell<tr><th>yyyy<th>z</table><div style='display: none'>no</div><script>1<2</script><div hidden>q</div>end"
)
TEXT = "Head\n\nOne two\n\nThree & four\nfive\n\n- a\n- b\n  1. c\n\nx     long cell\nyyyy  z\n\nend"


def test_layout_and_visibility():
    assert render(PAGE) == TEXT
    assert render(None) == render("") == ""
    assert render("<div>" * 20_000 + "deep") == "deep"
    assert render("a < b & c") == "a < b & c"


def test_rows(spark):
    df = spark.createDataFrame([(1, PAGE, "clash"), (1, PAGE, "x"), (2, None, None)], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in extract(df).collect()) == [(1, TEXT), (1, TEXT), (2, "")]
    assert extract(df.limit(0)).count() == 0


def test_implied_bodies():
    assert render("<html><head><title>T</title><p>Hello<p>World") == "Hello\n\nWorld"
    assert render("<head><title>a <b>b</b></title><meta x><style>p{}</style>\nHello <b>x</b>") == "Hello x"
    assert render("<title>T</title>Hi") == render("<title>T<p>Hi") == render("<head><title>T<p>Hi") == "Hi"
    assert render("<head><template><div>no</div></template><script>1</script><p>yes") == "yes"
    assert render("a<head>b</head>c") == "abc"


def test_drawings_formulas_and_fallbacks_are_seen():
    assert render("<p>see <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> ok") == "see x=2 ok"
    assert render("<svg><title>t</title><defs><text>no</text></defs><text>A</text><text>B</text></svg>z") == "A\nB\nz"
    assert render("<object data=x>fall</object> <noscript>back</noscript>") == "fall back"


def test_unclosed_elements_do_not_take_the_rest():
    for tag in ("svg", "svg><defs", "math", "math><annotation", "object", "noscript", "head><noscript", "head><title"):
        assert render(f"<{tag}><p>rest") == "rest", tag
    assert render("<div><datalist><option>a</div><p>rest") == render("<div><template>a</div><p>rest") == "rest"


def test_visibility_is_inherited():
    assert render("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<p>no</p></div>end") == "yes\n\nend"
    assert render("<div style='display:none'>no <b style='display:block;visibility:visible'>no</b></div>end") == "end"
    assert render("<p hidden>no</p><p hidden style='display:block'>yes</p><dialog>no</dialog><dialog open>box</dialog>") == "yes\n\nbox"
    assert render("<ul style='visibility:collapse'><li>no<li style='visibility:visible'>yes</ul>") == "- yes"


def test_cells_stand_on_a_grid():
    page = "<table><tr><th colspan=2>ab<th>c<tr><td rowspan=2>1<td>22<td>3<tr><td>x<td>y<tr><td colspan=3>a long cell over all columns</table>"
    assert render(page) == "ab     c\n1  22  3\n   x   y\na long cell over all columns"
    assert render("<table><tr><td colspan=1000>a<td>b<tr><td>cc<td>d</table>") == "a      b\ncc  d"
    assert render("<table><tr><td colspan=x>a<td colspan=0>b</table>") == "a  b"


def test_preformatted_text_keeps_its_lines():
    assert render("<p>a</p><pre>\n  x\n\n y\n</pre><p>b") == "a\n\n  x\n\n y\n\nb"


def test_long_pages_take_linear_time():
    import time

    began = time.time()
    render("<b>" * 30_000 + "</i>" * 30_000 + "x")
    render("<section>" * 30_000 + "<p>x</q>" * 30_000)
    render("<ul>" + "<li><i>x" * 30_000)
    assert time.time() - began < 20


def test_random_pages_show_all_that_is_visible_in_order():
    """Against the words that a plain recursion over the tree, as it was made, finds."""
    import random

    rng, number = random.Random(4), iter(range(10**6))

    def word():
        return f"w{next(number)}"

    def made(depth, visible, holder):
        tag = {"ul": "li", "table": "tr", "tr": "td"}.get(holder) or rng.choice(["div", "p", "b", "span", "ul", "table", "h2", "script", "i", "section"])
        if holder == "p" and tag in ("div", "p", "ul", "table", "h2", "section"):
            tag = "b"
        how = rng.choice(["", "", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'"])
        gone = how in (" hidden", " style='display:none'") or tag == "script"
        shows = how.endswith("visible'") or visible and not how.endswith("hidden'")
        inside, words = "", []
        for _ in range(rng.randrange(4)):
            if depth and rng.random() < 0.5 and tag != "script":
                own = tag if tag in ("ul", "table", "tr", "p") else "p" if holder == "p" else tag
                text, found = made(depth - 1, shows, own)
                inside += text
                words += found
            elif tag not in ("ul", "table", "tr"):
                w = word()
                inside += f" {w} "
                words += [w] if shows else []
        end = "" if tag in ("li", "td", "tr") and rng.random() < 0.5 else f"</{tag}>"
        return f"<{tag}{how}>{inside}{end}", [] if gone else words

    for _ in range(300):
        parts = [made(5, True, "body") for _ in range(3)]
        head = rng.choice(["", "<html><head><title>no</title></head><body>", "<head><title>no</title><style>no</style>"])
        assert [w for w in render(head + "".join(p for p, _ in parts)).split() if w != "-"] == [w for _, ws in parts for w in ws]
