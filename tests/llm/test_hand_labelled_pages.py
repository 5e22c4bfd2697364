"""Blocks of web pages with whole paths, and pages labelled by hand outside the training layouts."""

from stratavox.llm import html_extract
from stratavox.llm.html_blocks import blocks

A = "The river rose for three days before the dam was opened, and by Friday the lower fields stood under a metre of water."
B = "Nobody was hurt, the mayor said, but two bridges will stay closed until engineers have looked at every pillar."
C = "Farmers expect to lose a fifth of the harvest; the council will meet on Monday to discuss what help it can give."
D = "In the old town, shopkeepers carried their stock upstairs by hand while the fire brigade pumped out the cellars."

#: Page, and its main text by hand.
PAGES = [
    (f"<body><div class=site-nav><ul><li><a href=/>Start</a><li><a href=/n>News</a></ul></div><main id=story><h1>Flood in the valley</h1><p>{A}<p>{B}</main><div class=footer>Imprint</div>", ["Flood in the valley", A, B]),
    (f"<div id=wrap><header><a href=/>The Valley Post</a></header><article><h2>High water</h2><section><p>{A}</p><p>{C}</p></section></article><aside><h3>Most read</h3><ul><li><a href=1>Bridges closed</a></li></ul></aside></div>", ["High water", A, C]),
    (f"<body><nav><a href=/>Home</a> <a href=/w>Weather</a></nav><article><p>{B}</p><blockquote>{D}</blockquote><figure><figcaption>The bridge on Friday.</figcaption></figure></article><section class=comments><h3>2 comments</h3><p>{C}</p></section>", [B, D, "The bridge on Friday."]),
    (f"<div class='cookie-banner'><p>We use cookies to make this site work.</p><button>Accept</button></div><main><h1>Dam opened</h1><p>{A}</p><div class='ad'><p>Buy two pairs of boots, pay for one.</p></div><p>{B}</p></main><footer><p>All rights reserved.</p></footer>", ["Dam opened", A, B]),
    (f"<body><form class=search><label>Search</label><input></form><article><h1>After the flood</h1><p>{C}</p><ul><li>{D}</li><li>{A}</li></ul></article><form><p>Sign up for our letter</p><button>Send</button></form>", ["After the flood", C, D, A]),
    (f"<body><article><header><h1>Cellars full of water</h1></header><p>{D}</p><p>{B}</p><footer><a href=s>Share</a></footer></article><div class='related'><a href=2>More on the flood</a></div>", ["Cellars full of water", D, B]),
    (f"<body><ul class=menu><li>Sport<li>Culture</ul><div class=content><h1>Valley under water</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div class=sidebar><p>Tickets for the fair are on sale.</p></div>", ["Valley under water", A, B, C]),
    (f"<body><div class=post><h1>Letters</h1><p>{D}</p><p>{A}</p></div><ol class=commentlist><li>{B}</li><li>Well said.</li></ol><div id=footer>Contact</div>", ["Letters", D, A]),
]


def path(block):
    out, element = [], block.path
    while element is not None:
        out.append(element.tag)
        element = element.up
    return out[::-1]


def test_whole_paths():
    deep = "<main>" + "<div>" * 11 + "<nav>" + "<div>" * 30 + "<p>Menu</p>" + "</div>" * 30 + "</nav><p>Text</p>"
    menu, text = blocks(deep)
    assert path(menu) == ["main", *["div"] * 11, "nav", *["div"] * 30, "p"] and menu.path.depth == 44
    assert html_extract.label_by_markup([menu, text]).tolist() == [0, 1]
    vectors = html_extract.Vectors()
    assert html_extract.slot("t", "nav", html_extract.TAGS) in vectors.path(menu.path) and len(vectors.path(None)) == 0
    first, last = blocks("<nav>" + "<span>" * 70 + "Home</nav><article><p>Text</p></article>")
    assert "nav" in path(first) and path(last) == ["article", "p"]
    assert [path(b) for b in blocks("<b>x<div>y</b></div>z")] == [["b"], ["b", "div"], ["b"]]
    marks = blocks("<div class='a b c d e f g h i j sidebar'>x</div>")
    assert html_extract.label_by_markup(marks).tolist() == [0] and "sidebar" in marks[0].path.marks


def test_closed_links_and_paragraphs():
    one, two = blocks("<p><a href=x>one<p>two")
    assert (one.linked, two.linked) == (1.0, 0.0) and path(two) == ["p"]
    assert [path(b) for b in blocks("<ul><li>a<li>b</ul>c")] == [["ul", "li"], ["ul", "li"], []]


def test_all_words_of_a_block_are_read():
    words = " ".join(f"w{k}" for k in range(100))
    row = html_extract.Vectors().page(blocks(f"<p>{words} x. y.</p>"))[0]
    at = html_extract.TAGS + html_extract.PARENT
    counts = [0] * html_extract.WORDS
    for w in f"{words} x. y.".split():
        counts[html_extract.slot("w", w, html_extract.WORDS)] += 1
    norm = sum(c * c for c in counts) ** 0.5
    assert max(abs(a - c / norm) for a, c in zip(row[at : at + html_extract.WORDS], counts, strict=True)) < 1e-6
    assert abs(row[-html_extract.OTHER + 2] - 2 / 102) < 1e-6


def test_pages_labelled_by_hand(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = spark.createDataFrame([(k, None, page) for k, (page, _) in enumerate(PAGES)], "page_id long, url string, html string")
    model = html_extract.train(html_extract.sampled_pages(pages, "html", "page_id", html_extract.LabellerSettings()))
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(rows, labeller=model).collect()}
    wrong = sum(len(set(got[k]) ^ set(want)) for k, (_, want) in enumerate(PAGES))
    total = sum(len(blocks(page)) for page, _ in PAGES)
    print("blocks labelled wrongly:", wrong, "of", total, [set(got[k]) ^ set(want) for k, (_, want) in enumerate(PAGES)])
    assert wrong <= 0.1 * total
