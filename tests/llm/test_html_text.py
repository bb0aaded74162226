import time

import pytest

from marlstone.llm.html_text import extract, main_text

PARA = "<p>" + "word " * 40 + "</p>"
TEXT = ("word " * 40).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><h1>T &lt; U</h1><p><b>x<br>y</p></article>", "T < U\n\nx y"),
        ("<nav><a href=/>home</a></nav><article><h1>T</h1>" + PARA + "<p>s</p></article><footer>f</footer>", f"T\n\n{TEXT}\n\ns"),
        ("<header>site</header><main><h1>T</h1>" + PARA + "<aside>no</aside><form>no</form></main>", f"T\n\n{TEXT}"),
        ("<div class='menu'>m</div><div id=wrap><h1>T</h1><div class=c1>" + PARA * 2 + "</div></div><div class='comments'>" + PARA + "</div>", f"T\n\n{TEXT}\n\n{TEXT}"),
        ("<div class=z><ul>" + "<li><a href=/>link text here</a></li>" * 20 + "</ul></div><div class=y>" + PARA * 2 + "</div>", f"{TEXT}\n\n{TEXT}"),
        ("<article><p>a</p><section class='reader-comments'><p>hi</p></section><div class='cookie-notice'>c</div><p>b</p></article>", "a\n\nb"),
        ("<article class='has-sidebar'><header><h1>T</h1></header><p>a&nbsp; b\n c</p></article>", "T\n\na b c"),
        ("<script>var a='<p>x</p>';</script><style>p{}</style><p>y</p><noscript>z</noscript>", "y"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "one\n\ntwo\n\n1\n\n2"),
        ("<p hidden>h</p><p style='display: none'>n</p><p>v</p>", "v"),
        ("<!-- c --><![CDATA[raw <b>]]> x", "raw <b> x"),
        ("<p>a < b and <3 c</p>", "a < b and <3 c"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_broken_pages_end_soon():
    began = time.time()
    for page in ("<" * 30_000, "<p " * 20_000, "<a href='" * 5000, "<div>" * 3000 + "x", "<b>" * 3000 + "x", "</p>" * 20_000, "<!--" * 5000):
        main_text(page)
    assert time.time() - began < 20


def test_deep_nesting_takes_linear_time():
    n = 100_000
    for page, size in (("<div>x" * n + "</div>" * n, 3 * n - 2), ("<div><b></i></span>" * n + "x", 1), ("<li><span>" * n + "x", 1), ("<tr><td><table>" * n + "x", 1)):
        began = time.time()
        assert len(main_text(page)) == size
        assert time.time() - began < 5


def test_density_finds_articles_by_any_name(sf):
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()
    same = sum(main_text(p) == main_text(re.sub(r"(</?)(article|main)\b", r"\1div", p)) for p in pages)
    assert same >= 0.95 * len(pages)  # an article of a few words is hard to tell from a notice


def test_rows(spark, sf):
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(df).collect()) == [(0, "x"), (1, ""), (2, ""), (2, "")]
    assert extract(df.limit(0)).count() == 0
    pages = extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert all(r.text for r in pages)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='page-with-sidebar'><p>x</p>" + PARA + "</div>", f"x\n\n{TEXT}"),
        ("<div class='layout-sidebar-right'><div class=c>" + PARA * 2 + "</div><div class=sidebar>s</div></div>", f"{TEXT}\n\n{TEXT}"),
        ("<div class='two-col sidebar-left'><article>" + PARA + "</article></div><div class=x><p>short</p></div>", TEXT),
        ("<div class='search-result-article'>" + PARA + "</div><div class=menu><a href=/>m</a></div>", TEXT),
        ("<div class=wrap><div class='article-header'><h1>T</h1></div><div class=c>" + PARA * 2 + "</div></div>", f"T\n\n{TEXT}\n\n{TEXT}"),
        ("<form id=aspnet><div class=c>" + PARA * 2 + "</div><fieldset>f</fieldset></form>", f"{TEXT}\n\n{TEXT}"),
        ("<div role=search><p>only</p></div>", "only"),
        ("<article>" + PARA + "</article><div class=comments>" + PARA * 5 + "</div>", TEXT),
    ],
)
def test_names_are_weighed(page, want):
    assert main_text(page) == want


# -- the method a second time, on pages whose tags are all closed: a tree of dictionaries, every figure by its definition


def plain_tree(page):
    from html.parser import HTMLParser

    root = {"tag": "body", "kids": [], "away": False, "link": False}
    stack, skip = [root], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title", "noscript"):
                skip.append(tag)
            if tag in ("html", "head", "body", "meta") or skip:
                return
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().split()
            away = tag in ("nav", "footer", "aside", "form") or any(n in ("ad", "comments", "cookie-notice", "menu") for n in names)
            node = {"tag": tag, "kids": [], "away": stack[-1]["away"] or away, "link": stack[-1]["link"] or tag == "a", "attrs": attrs}
            stack[-1]["kids"].append(node)
            if tag != "br":
                stack.append(node)

        def handle_endtag(self, tag):
            if skip:
                skip.pop()
            elif tag in [n["tag"] for n in stack[1:]]:
                while stack.pop()["tag"] != tag:
                    pass

        def handle_data(self, data):
            if not skip:
                stack[-1]["kids"].append(data)

    Reader().feed(page)
    return root


def plain_text(page):
    import math

    root = plain_tree(page)

    def nodes(node):
        """A node and all nodes in it that are not set aside."""
        return [node, *(m for k in node["kids"] if isinstance(k, dict) and not k["away"] for m in nodes(k))]

    def size(node, linked=False):
        return sum(len("".join(k.split())) for m in nodes(node) for k in m["kids"] if isinstance(k, str) and (m["link"] or not linked))

    c_b, lc_b = size(root), size(root, True)

    def density(node):
        c, lc = size(node), size(node, True)
        t, lt = len(nodes(node)) - 1, sum(m["tag"] == "a" for m in nodes(node)[1:])
        if not c:
            return 0
        base = math.log(c / max(c - lc, 1) * lc + lc_b / c_b * c + math.e)
        inside = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)
        weight = math.log(inside) / max(math.log(base), 1e-9) if base > 1.0001 else math.log(max(c / max(lc, 1), 1)) + 1
        return c / max(t, 1) * max(0, weight)

    def kids(node):
        return [k for k in node["kids"] if isinstance(k, dict) and not k["away"]]

    def total(node):
        return sum(map(density, kids(node)))

    if not c_b:
        return ""
    everything = nodes(root)
    core = max(everything, key=total) if max(map(total, everything)) > 0 else root
    parents = {id(k): m for m in everything for k in kids(m)}
    path = [core]
    while path[-1] is not root:
        path.append(parents[id(path[-1])])
    threshold = min(map(density, path))
    prose_tags, heads = ("p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"), ("h1", "h2", "h3", "h4", "h5", "h6")
    whole, own_text = [core], []
    for below, up in zip(path, path[1:]):  # noqa: B905
        open_ = up is root or any(isinstance(k, dict) and k["away"] for k in up["kids"])
        siblings = kids(up)
        belongs = []
        for k in siblings:
            good = size(k) and 2 * size(k, True) <= size(k)
            same_part = k["tag"] == below["tag"] and (k["tag"] in ("article", "main", "section") or k["attrs"] == below["attrs"])
            part_of_prose = k["tag"] in prose_tags and (up is not root or core["tag"] in prose_tags)
            belongs.append(k is below or bool(good and (not open_ or density(k) >= threshold or total(k) >= threshold or same_part or part_of_prose)))
        first, last = belongs.index(True), len(belongs) - 1 - belongs[::-1].index(True)
        for i, k in enumerate(siblings):
            good = size(k) and 2 * size(k, True) <= size(k)
            if k is not below and good and (belongs[i] or first < i < last or k["tag"] in heads):
                whole.append(k)
        text = sum(len("".join(k.split())) for k in up["kids"] if isinstance(k, str))
        if text and (not open_ or text >= threshold):
            own_text.append(up)
            whole += [k for k in siblings if k["tag"] in ("a", "b", "i", "span", "em", "code") and k is not below]
    blocks = [[]]

    def write(node, inside):
        inside = inside or any(node is k for k in whole)
        if node["away"]:
            inside = False
        block = node["tag"] not in ("a", "b", "i", "span", "em", "code", "br")
        if block:
            blocks.append([])
        if node["tag"] == "br" and inside:
            blocks[-1].append(" ")
        for k in node["kids"]:
            if isinstance(k, dict):
                write(k, inside)
            elif inside or any(node is m for m in own_text):
                blocks[-1].append(k)
        if block:
            blocks.append([])

    write(root, False)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def variants(page):
    """(name, page, what is added to its text) for a page whose paragraphs stand in one article."""
    import re

    m = re.search(r"<article>(<h1>.*?</h1>)?(.*)</article>", page, re.S)
    head, tail, h = page[: m.start()], page[m.end() :], m[1] or ""
    ps = [p for p in re.split(r"(?=<p>)", m[2]) if p]
    cut = lambda k: ["".join(ps[i * len(ps) // k : (i + 1) * len(ps) // k]) for i in range(k)]
    wrap = lambda tag, k: "".join(f"<{tag}>{x}</{tag}>" for x in cut(k) if x)
    yield "as it is", page, ""
    for k in (2, 3):
        yield "sections", f"{head}<article>{h}{wrap('section', k)}</article>{tail}", ""
        yield "divs", f"{head}<div class=z>{h}{wrap('div', k)}</div>{tail}", ""
        yield "bare divs", f"{head}{h}{wrap('div', k)}{tail}", ""
    yield "articles", f"{head}{h}{wrap('article', 2)}{tail}", ""
    yield "list", f"{head}<article>{h}<div>{m[2]}</div><ul><li>one</li><li>two</li></ul></article>{tail}", "\n\none\n\ntwo"
    yield "end", f"{head}<div class=z>{h}<div>{m[2]}</div><div>The end.</div></div>{tail}", "\n\nThe end."
    yield "code", f"{head}<article>{h}<div>{cut(2)[0]}</div><pre><code>x = 1\ny = 2</code></pre><div>{cut(2)[1]}</div></article>{tail}", "\n\nx = 1 y = 2"
    yield "comments", page.replace("</article>", '</article><div class="comments"><p>' + "nice post " * 30 + '</p></div><div class="cookie-notice">We use</div>'), ""


def closed(page):
    """The page with its paragraphs closed, for the plain reader."""
    import re

    return re.sub(r"<p>(.*?)(?:</p>)?(?=<p>|</article>|</section>|</div>|<pre>|<ul>)", r"<p>\1</p>", page, flags=re.S)


def test_whole_articles_and_the_method_written_plainly(sf):
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist() if "<article>" in p and len(p) < 6_000]
    pages = [p for p in pages if len(main_text(p)) > 300][:40]  # with less, names are weighed against the text, which the plain reader doesn't
    seen = good = 0
    for page in pages:
        for name, variant, added in variants(page):
            got = main_text(variant)
            seen, want = seen + 1, main_text(page)
            good += (got.replace(added, "", 1) if added and added in got else got if not added else None) == want
            assert plain_text(closed(variant)) == got, name
    assert seen > 200 and good >= 0.98 * seen


def test_unclosed_script_is_linear():
    began = time.time()
    main_text("<script>" + "</script" * 200_000)
    assert time.time() - began < 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div>" + PARA + "</div><div>" + PARA + "</div>", f"{TEXT}\n\n{TEXT}"),  # equal sums
        ("<div class=w>see <a href=/>here</a> first<div>" + PARA * 2 + "</div>and last</div>", f"see here first\n\n{TEXT}\n\n{TEXT}\n\nand last"),
        ("<div class=w><p>one</p></div><div>" + PARA * 2 + "</div><div><p>two</p></div><div class=x><p>three</p></div>", f"{TEXT}\n\n{TEXT}\n\ntwo"),
        ("<div class=w><div>" + PARA * 2 + "</div><ul>" + "<li><a href=/>link text</a></li>" * 9 + "</ul></div>", f"{TEXT}\n\n{TEXT}"),
    ],
)
def test_around_the_core(page, want):
    assert main_text(page) == want
