import random
import re
from html.parser import HTMLParser

from claimgrid.llm import html_text as H


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site name</header><nav><a href=x>Home</a></nav>
    <div class="ad">Buy &amp; buy</div><article><header><h1>Head&nbsp;line</h1></header><p>One  <b>bold</b>\n word<p>&lt;tag&gt; &#233;<br>next<p>Ok.</p><div class="commentSection"><p>I say so and so on and on.</p></div><aside>More</aside><form><p>Mail</p></form></article><footer>&copy; x</footer></body></html>"""
    assert H.main_text(page) == "Head line\nOne bold word\n<tag> é next\nOk."


def test_pages_without_an_article():
    text = "This is a long enough paragraph of running text that surely is the main content of the page and more."
    page = f"<ul><li><a href=x>Home</a><li><a href=y>About us</a></ul><div><h2>Title of it</h2><p>{text}</p><p>Short one.</p><p>{text}</p></div><div id='cookie-notice'>{text}</div><p><a href=z>Read more of this here now</a></p>"
    assert H.main_text(page) == f"Title of it\n{text}\nShort one.\n{text}"


def test_broken_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>a</nav>") == ""
    assert H.main_text("<article><p>x &am") == "x &am"
    assert H.main_text("<article><p>x<p") == "x"
    assert H.main_text("<article><p>a < b<script>never ends") == "a < b"
    long = "word " * 50_000
    assert H.main_text(f"<article>{'<p>' + long + '</p>'}</article>") == long.strip()
    assert H.main_text("<div>" * 3000 + "<article>deep") == "deep"


def test_operator(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x</p>", "t", 1), (1, None, None, "t", 1), (None, "u", "", None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, H.extract(df).collect()), key=str) == sorted([(1, "u", "x", 1), (1, None, "", 0), (None, "u", "", 0)], key=str)
    assert H.extract(df.limit(0)).count() == 0


TEXT = "This is a long enough paragraph of running text that surely is the main content of the page and more."


def test_elements_that_close_themselves_or_stay_open_keep_the_rest():
    for odd in ("<svg width='1'/>", "<button>Share", "<object data=x>", "<select><option>a", "<iframe src=x>", "<iframe src=x />", "<canvas>", "<textarea>", "<noscript>", "<button/>"):
        page = f"<article><p>{TEXT}</p>{odd}<p>{TEXT} Two.</p><p>Three {TEXT}</p></article>"
        kept = H.main_text(page).split("\n")
        assert [t for t in kept if t.endswith("more.") or t.endswith("Two.")] == [TEXT, f"{TEXT} Two.", f"Three {TEXT}"], odd
    page = f"<article><p>{TEXT} <button>Share <svg><path d='M0'/><text>x</text></svg></button> end</p><p>Two <select><option>a<option>b</select>{TEXT}</article>"
    assert H.main_text(page) == f"{TEXT} end\nTwo {TEXT}"
    assert H.main_text(f"<article><p>{TEXT}<button>One<button>Two</button> tail</p><script src=x /><p>Last {TEXT}</p></article>") == f"{TEXT} tail\nLast {TEXT}"


def test_marks_on_any_element():
    for tag in ("p", "h2", "li", "span", "a", "div", "td", "figcaption"):
        for mark in ("ad", "cookie-notice", "siteComments"):
            page = f"<article><p>{TEXT}</p><{tag} class='{mark}'>Gone {TEXT}</{tag}><p>Last {TEXT}</p></article>"
            assert H.main_text(page) == f"{TEXT}\nLast {TEXT}", (tag, mark)
    assert H.main_text(f"<article><p>{TEXT} <span class=ad>Buy <span>now</span> please</span> end</p><pre>x <span class='comment'># note</span></pre></article>") == f"{TEXT} end\nx # note"
    assert H.main_text(f"<article><p class=ad>Gone {TEXT}<p>{TEXT}<ul><li class=promo>Gone<li>Kept item<li>More</ul></article>") == f"{TEXT}\nKept item\nMore"
    assert H.main_text(f"<article><p>{TEXT}<p><span class=ad>Gone {TEXT}<p>Kept {TEXT}</article>") == f"{TEXT}\nKept {TEXT}"


def test_links_around_blocks():
    page = f"<div><h2>Title of it</h2><p>{TEXT}</p><p>{TEXT}</p></div><a href=x><div><p>Read this other story on our site now please</p></div></a>"
    texts, features = H.page_blocks(page)
    assert features[:, 1].tolist() == [0, 0, 0, 1]
    assert H.main_text(page) == f"Title of it\n{TEXT}\n{TEXT}"
    assert H.page_blocks("<p>a <a href=x>b</p><p>c d</p><a>e <a>f</a>")[1][:, 1].tolist() == [0.5, 0, 1]


class Tree(HTMLParser):
    """The blocks of a well-formed page by walking up from each text: (text, linked words, furniture, article, main, heading)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.blocks, self.fresh = [], [], True
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCKS:
            self.fresh = True
        if tag not in H.VOID:
            self.path.append((tag, dict(attrs).get("class", "")))
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.path.pop()
        if tag in H.BLOCKS:
            self.fresh = True

    def handle_data(self, data):
        names = [t for t, _ in self.path]
        if any(t in H.UNSEEN | H.RAW for t in names):
            return
        if self.fresh:
            self.blocks.append([[], [], [], None])
            self.fresh = False
        around = [(t, c) for t, c in self.path if t in H.BLOCKS]
        bad = any(t in H.FURNITURE_TAGS or c == "ad" or t == "header" and "article" not in [u for u, _ in self.path[:i]] for i, (t, c) in enumerate(self.path) if t in H.BLOCKS)
        block = self.blocks[-1]
        apart = any(c == "ad" and t not in H.BLOCKS and not {"pre", "code"} & set(names[: i + 1]) for i, (t, c) in enumerate(self.path))
        block[2 if apart else 0].append(data)
        if "a" in names and not apart:
            block[1].append(data)
        article = any(t == "article" and c != "ad" for t, c in around)
        block[3] = (bad, article, any(t == "main" for t, _ in around), bool(around) and any(t[0] == "h" and t[1:].isdigit() for t, _ in around))

    def rows(self):
        for own, linked, apart, (bad, article, main, head) in self.blocks:
            text, link = " ".join("".join(own).split()), len("".join(linked).split())
            if not text and "".join(apart).split():
                text, bad = " ".join("".join(apart).split()), True
                link = len(text.split())
            if text:
                yield text, min(1.0, link / len(text.split())), bad, article, main, head


def random_page(rnd, depth=0):
    """Well-formed markup: blocks that hold blocks, leaves with inline elements."""
    mark = lambda: rnd.choice(["", "", "", " class='ad'", " class='with-ad'", " class='x'"])
    words = lambda: " ".join(rnd.choice(["word", "a&amp;b", "é", "text", "&lt;p&gt;"]) for _ in range(rnd.randint(1, 6)))

    def inline(level):
        out = words()
        for _ in range(rnd.randint(0, 2) if level < 3 else 0):
            tag = rnd.choice(["b", "span", "a", "button", "svg", "code"] if level < 2 else ["i"])
            inner = re.sub(rf"(</?){tag}\b", r"\1u", inline(level + 1)) if tag in ("a", "button") else inline(level + 1)
            out += rnd.choice(["", " "]) + f"<{tag}{mark()}>{inner}</{tag}>" + rnd.choice(["<br>", " ", "<!-- no -->"]) + words()
        return out

    out = ""
    for _ in range(rnd.randint(1, 4)):
        if depth < 3 and rnd.random() < 0.5:
            tag = rnd.choice(["div", "section", "article", "main", "header", "footer", "nav", "aside", "blockquote"])
            out += f"<{tag}{mark() if tag != 'main' else ''}>{random_page(rnd, depth + 1)}</{tag}>"
        elif rnd.random() < 0.2:
            out += "<ul>" + "".join(f"<li{mark()}>{inline(0)}</li>" for _ in range(3)) + "</ul>"
        elif rnd.random() < 0.2:
            out += "<script>var t = '<p>no</p>';</script><style>p{}</style>"
        else:
            tag = rnd.choice(["p", "h1", "h3", "p", "pre"])
            out += f"<{tag}{mark()}>{inline(0)}</{tag}>"
    return out


def test_blocks_match_a_walk_over_the_tree():
    for seed in range(400):
        page = random_page(random.Random(seed))
        want = list(Tree(page).rows())
        texts, features = H.page_blocks(page)
        assert texts == [w[0] for w in want], page
        if want:
            dense, bad, head = (features[:, k].tolist() for k in (1, 6, 8))
            assert dense == [w[1] for w in want] and bad == [float(w[2]) for w in want] and head == [float(w[5]) for w in want], page
