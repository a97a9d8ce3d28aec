"""Golden cases for the HTML tree walk (X3) and property tests for the line diff (M8)."""
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.operators.diff import apply_chunks, chunks, render_line_diff
from webloom.operators.markdown import to_markdown


def test_headings_lists_code_links():
    html = ('<body><h1>T</h1><p>a <a href="/x">link</a> and <i>it</i></p>'
            '<ul><li>one<li>two</ul><pre><code class="language-py">x = 1\n</code></pre></body>')
    md = to_markdown(html)
    assert md == "# T\n\na [link](/x) and _it_\n\n-   one\n-   two\n\n```py\nx = 1\n```"


def test_raw_text_and_removed_elements():
    html = '<body><script>var t="</p>";</script><style>p{}</style><p>kept</p><noscript><p>x</p></noscript></body>'
    assert to_markdown(html) == "kept"


def test_unclosed_bold_reopens_in_next_paragraph():
    md = to_markdown("<body><p><b>bold<br><p>next</p></body>")
    assert md.startswith("**bold")
    assert "**next**" in md


def test_missing_body_end_and_escapes():
    md = to_markdown("<html><body><p>a*b_c [x] # not heading")
    assert md == r"a\*b\_c \[x\] # not heading"


def test_no_body_content():
    assert to_markdown("") == ""
    assert to_markdown(None) == ""


def test_diff_chunk_prefixes():
    assert render_line_diff("a\nb\nc\n", "a\nx\nc\nd") == "-b\n+x\n+d"
    assert render_line_diff("", "new\n") == "+new\n"
    assert render_line_diff("old\n", "") == "-old\n"
    assert render_line_diff("a\nb\n", "a\nb\n") == ""
    # multi-line chunk gets one prefix
    assert render_line_diff("a\n", "a\nb\nc\n") == "+b\nc\n"


lines = st.lists(st.sampled_from(["x\n", "y\n", "z\n", "w", "\n"]), max_size=15).map("".join)


@settings(max_examples=200, deadline=None)
@given(lines, lines)
def test_diff_edit_script_rebuilds_both_texts(a, b):
    ops = chunks(a, b)
    assert apply_chunks(a, ops) == b
    assert "".join(t for k, t in ops if k != "+") == a


CONVERSIONS = [
    ("<p>Hello <b>world</b>!</p>", "Hello **world**!"),
    ("<ol start=\"3\"><li>a</li><li>b</li></ol>", "3.  a\n4.  b"),
    ("<ul><li>a<ul><li>b</li></ul></li></ul>", "-   a\n    -   b"),
    ("<p><a href=\"/x\" title=\"t\">link</a></p>", "[link](/x \"t\")"),
    ("<p><img src=\"a.png\" alt=\"A\"></p>", "![A](a.png)"),
    ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n> \n> r"),
    ("<p>use <code>x_y</code> now</p>", "use `x_y` now"),
    ("<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    ("<p>a <em> b </em> c</p>", "a _b_ c"),
    ("<p>  lots   of\n  space  </p>", "lots of space"),
    ("<div> x <p> y </p> z </div>", "x\n\ny\n\nz"),
    ("<pre><code>  keep  \n spaces</code></pre>", "```\n  keep  \n spaces\n```"),
    ("<p>1. not a list</p>", "1\\. not a list"),
    ("<p>- not bullet</p>", "\\- not bullet"),
]


def test_common_conversions():
    for html, want in CONVERSIONS:
        assert to_markdown("<body>" + html + "</body>") == want, html


@settings(max_examples=200, deadline=None)
@given(lines, lines)
def test_diff_net_counts_equal_multiset_difference(a, b):
    from collections import Counter

    from webloom.operators.diff import split_lines
    net = Counter()
    for kind, text in chunks(a, b):
        for line in split_lines(text):
            net[line] += {"+": 1, "-": -1, " ": 0}[kind]
    want = Counter(split_lines(b))
    want.subtract(Counter(split_lines(a)))
    assert {k: v for k, v in net.items() if v} == {k: v for k, v in want.items() if v}


def test_m8_agrees_with_m9_on_fixture(spark):
    """The net line counts implied by every M8 diff equal M9's counts."""
    from collections import Counter

    from webloom.operators import monitor as M
    from webloom.operators.diff import split_lines
    from webloom.sources import fixtures as FX
    sf = "/root/testdata/sf0.001"
    ch = M.changed_pages(FX.monitor_cur(spark, sf), M.snapshot_state(FX.monitor_prev(spark, sf)))
    m9 = {(r.url, r.line): r.net for r in M.line_change_counts(ch).collect()}
    implied = Counter()
    for r in ch.collect():
        for kind, text in chunks(r.old_markdown, r.new_markdown):
            for line in split_lines(text):
                implied[(r.url, line)] += {"+": 1, "-": -1, " ": 0}[kind]
    assert {k: v for k, v in implied.items() if v} == m9
