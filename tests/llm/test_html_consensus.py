"""What a host's pages decide together, against pages put together from parts that are known."""

import random
from html.parser import HTMLParser

from crestline.llm import html

SCHEMA = "page_id long, url string, html string, host string, winner long, same string"


def texts(spark, pages):
    rows = [(i, url, page, "h", 1, "x") for i, (url, page) in enumerate(pages)]
    return [r["text"] for r in sorted(html.extract_main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=lambda r: r["page_id"])]


def article(rng, n):
    return " ".join(rng.choices(["some", "words", "of", "an", "article", "that", "go", "on"], k=n)) + f" {rng.random()}"


def test_the_vote_changes_the_text(spark):
    """A box without a telling name, the same on pages with different articles, goes; on a page alone it stays."""
    rng = random.Random(1)
    box = "<div class='x7'>Join our circle of friends, it is the best one, and tell all others.</div>"
    bodies = [article(rng, 12) for _ in range(5)]
    page = "<body><div class='q1'><p>{}</p></div>" + box + "<div class='x8'>{}</div></body>"
    pages = [("http://many.org/", page.format(b, f"Note {i}.")) for i, b in enumerate(bodies)] + [("http://one.org/", page.format(bodies[0], "Note."))]
    got = texts(spark, pages)
    assert got[:5] == [f"{b}\nNote {i}." for i, b in enumerate(bodies)]
    assert got[5] == f"{bodies[0]}\nJoin our circle of friends, it is the best one, and tell all others.\nNote."


def test_copies_of_a_page_are_one_page(spark):
    """An article that a host has under many addresses, also with other boxes around it, is no boilerplate."""
    rng = random.Random(2)
    shared, others = article(rng, 30), [article(rng, 30) for _ in range(2)]
    page = "<body><div class='lead'>{}</div><div class='text'><p>{}</p></div><div class='x{}'>{}</div></body>"
    pages = [("http://copies.org/", page.format("Its lead.", shared, "", f"Box {i % 3}")) for i in range(9)] + [("http://copies.org/", page.format("Another lead.", o, "", "Box")) for o in others]
    got = texts(spark, pages)
    assert got[:9] == [f"Its lead.\n{shared}\nBox {i % 3}" for i in range(9)] and got[9:] == [f"Another lead.\n{o}\nBox" for o in others]


def test_named_parts_go_whatever_their_length(spark):
    rng = random.Random(3)
    brief, long = article(rng, 20), article(rng, 900)
    parts = [f"<div class='comments'>{long}</div>", f"<div id='user-discussion'><p>{long}</p></div>", f"<div class='fb-comments-box'>{long}</div>", f"<div class='related'>{long}</div>", "<div class='notice'>Mind the cookies.</div>", "<div class='menu-left'><a href=/>Home</a> and away</div>", "<ul class='left-menu-wrap'><li>Home</li></ul>", "<div class='adbox'>Buy it now.</div>", "<p class='copyright'>All rights.</p>"]
    pages = []
    for i, part in enumerate(parts):
        pages += [(f"http://p{i}.org/", f"<body><article><p>{brief}</p></article>{part}</body>"), (f"http://in{i}.org/", f"<body><div class='post'><h1>Head</h1><p>{brief}</p>{part}</div></body>")]
    assert texts(spark, pages) == [brief, f"Head\n{brief}"] * len(parts)


def test_lists_of_links_beside_the_content_go(spark):
    rng = random.Random(4)
    body, links = article(rng, 30), "".join(f"<li><a href=/{i}>Part {i} of it all</a></li>" for i in range(40))
    pages = [("http://l.org/", f"<body><div class='left-col'><ul>{links}</ul></div><article><p>{body}</p><ul>{links}</ul></article></body>"), ("http://m.org/", f"<body><div class='left-col'><ul>{links}</ul></div></body>")]
    listed = "\n".join(f"Part {i} of it all" for i in range(40))
    # A list within the article is of the article; a page that is a list has it as its text.
    assert texts(spark, pages) == [f"{body}\n{listed}", listed]


def test_pages_put_together_from_parts(spark):
    """A second extractor that knows each page's template and marks: it keeps the text of marked elements alone."""

    class Marked(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.depth, self.kept, self.blocks = 0, 0, []
            self.feed(page)

        def handle_starttag(self, tag, attributes):
            self.depth += 1
            if not self.kept and ("data-keep", None) in attributes:
                self.kept = self.depth
            if self.kept and tag in ("p", "h1", "li", "div"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.kept = 0 if self.depth == self.kept else self.kept
            self.depth -= 1

        def handle_data(self, data):
            if self.kept:
                self.blocks[-1] += data

        def text(self):
            return "\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)

    rng = random.Random(5)
    pages = []
    for host in range(8):
        main, wrap = rng.choice(["article", "div class='entry'", "div class='story-#7'", "section"]), rng.choice(["div class='layout'", "div class='sidebar'", "main"])
        slogan = f"<div class='z{host}'>The same words on each page of host number {host}, always.</div>"
        for n in range(rng.choice([4, 7])):
            paragraphs = "".join(f"<p>{article(rng, rng.randint(3, 60))}</p>" for _ in range(rng.randint(1, 5)))
            comments = f"<div class='comments'><p>{article(rng, rng.randint(5, 400))}</p></div>" if rng.random() < 0.6 else ""
            aside = "".join(f"<li><a href='/{i}'>{article(rng, 3)}</a></li>" for i in range(rng.randint(2, 30)))
            inner = f"<{main} data-keep><h1>Head {n} &amp; more</h1>{paragraphs}</{main.split()[0]}>"
            pages.append((f"http://host{host}.org/{n}", f"<html><body><nav><a href=/>x</a></nav><{wrap}>{slogan}{inner}{comments}</{wrap.split()[0]}><ul class='left-col'>{aside}</ul><footer>end</footer></body></html>"))
    assert texts(spark, pages) == [Marked(page).text() for _, page in pages]
