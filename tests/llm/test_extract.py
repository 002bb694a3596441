import random

from crawlframe.llm import extract as ex

PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><a href=/>Site</a></header><nav><ul><li>Menu</ul></nav><div class='ad'>Buy</div>"
        "<div id=main-12><h1>He&eacute;d</h1><p>One &amp; <b>two<br>three<p>Four <a href=x>link</a>.<div class='ad-slot'>share</div>"
        "<!-- <p>no</p> --><ul><li>five<li>six</ul><form>f<input></form><aside>side</aside>"
        "<div id='comments'><p>a reader comment that is longer than all the rest of the page's own text put together, well</p></div></div>"
        "<div class='cookie notice'>Cookies</div><footer>&copy;</footer></body></html>")
WANT = "Heéd\n\nOne & two three\n\nFour link.\n\nfive\n\nsix"


def text(source):
    page = ex.Page(source)
    return page.text_under(page.best_path())


def test_main_text_of_one_page():
    assert text(PAGE) == WANT
    assert text("") == "" and text("no markup &lt; here") == "no markup < here" and text("<p>cut &am") == "cut &am"
    assert text("<article><header><h2>Head</h2><span>by X</span></header><p>Body</article>") == "Head\n\nBody"
    assert text("<body><p>open <a href=\"x\">un<p title='a>b'>closed</p><nav>menu") == "open un\n\nclosed"
    assert text("<nav><p>only menu</p></nav>") == ""


def test_long_and_damaged_pages():
    many = "<p>x" * 50_000
    assert text(f"<article>{many}</article>").count("\n\n") == 49_999
    assert text("<a " * 20_000) == ""
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<script>" + "x" * 1000) == ""


def test_host_consensus_overrules_a_page(spark):
    own = "<body><div class='story-{k}'><p>Real text {k}</p></div><div class='box'><p>{rest}</p></div></body>"
    rows = [(k, f"http://h.org/{k}", own.format(k=k, rest="short")) for k in range(20)]
    rows += [(50, "http://H.org:80/x", own.format(k=50, rest="a box with much more text than the story has " * 9))]
    rows += [(60, "http://h.org/other", "<body><div class='lone'><p>Another template altogether</p></div></body>")]
    rows += [(70, None, None), (71, "not a url", "<p>Hostless</p>"), (72, "http://h.org/e", "")]
    df = spark.createDataFrame([(*r, "keep") for r in rows], "page_id long, url string, html string, path string").repartition(4)
    got = {r.page_id: r for r in ex.extract(df).collect()}
    assert all(got[k].text == f"Real text {k}" and got[k].path == "keep" for k in (*range(20), 50))
    assert got[60].text == "Another template altogether" and got[71].text == "Hostless"
    assert got[70].text == "" and got[70].n_chars == 0 and got[72].text == ""
    assert got[50].n_chars == len(got[50].text)
    assert ex.extract(df.limit(0)).count() == 0


def test_names_decide_only_as_whole_names():
    inside = ("<div class='social-history'>A</div><section id='search-methods'>B</section><p class='alert-levels'>C</p><p class=related>D</p>"
              "<div class='commentary'>E</div><div class='adverbs header-files'>F</div><noscript>G</noscript><p hidden>H</p><div style='display:none'>I</div>")
    assert text(f"<article><p>Start</p>{inside}</article>") == "Start\n\nA\n\nB\n\nC\n\nD\n\nE\n\nF\n\nG\n\nH\n\nI"
    outside = "".join(f"<div class='{n}'>gone</div>" for n in ("ad", "ad-box", "site_footer", "topNav", "cookie notice", "comments-list", "sponsored block", "Sidebar2"))
    assert text(f"<article><p>Start</p>{outside}<div role=banner>gone</div></article>") == "Start"


def test_inline_parts_are_left_out_too():
    assert text("<article><p>Keep <span class='advert'>Buy now</span>this <select><option>one<option>two</select>and "
                "<span class='comments'>first!</span>that <button>Send</button><label>stays</label>.</p></article>") == "Keep this and that stays."


def test_all_containers_of_an_article_come_back():
    long = "much longer text than the first part has, by far " * 5
    assert text(f"<body><article><div class=intro>Short.</div><div class=rest><p>{long}</p></div></article>") == f"Short.\n\n{long.strip()}"
    assert text(f"<body><div class=wrap><div class=one><p>{long}</p></div><div class=two><p>{long}!</p></div></div>") == f"{long.strip()}\n\n{long}!"
    assert text(f"<main><section class=a><p>First.</p></section><section class=b><p>{long}</p></section></main>") == f"First.\n\n{long.strip()}"


def test_generated_pages_give_back_their_known_text(spark):
    """Pages made from blocks of known text and parts to leave out, in random order and nesting, over three hosts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg\u00e9") for _ in range(rng.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(rng.randrange(2, n)))
    gone = ["<nav><ul><li><a href=/>{}</a></ul></nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<form><p>{}<input></form>", "<script>{}</script>",
            "<style>{}</style>", "<!-- {} -->", "<footer>{}</footer>", "<div id='comments'><p>{}</p></div>", "<div class='cookie-notice'>{}</div>"]
    rows, want = [], {}
    for k in range(300):
        blocks, html = [], ""
        for _ in range(rng.randrange(3, 20)):
            if rng.random() < 0.3:
                html += rng.choice(gone).format(words(12))
                continue
            t = words(30)
            cut = rng.randrange(len(t))
            shown = rng.choice(["{}", "<b>{}</b>", "{} <a href=/x>{}</a>", "{}<span class=advert>buy</span>", "{} &amp; {}"])
            n = shown.count("{}")
            inner = shown.format(*([t] if n == 1 else [t[:cut], t[cut:]]))
            plain = t if n == 1 else f"{t[:cut]} & {t[cut:]}" if "&" in shown else f"{t[:cut]} {t[cut:]}"
            tag = rng.choice(["p", "div", "h2", "blockquote", "li", "section class='part 3'"])
            html += f"<{tag}>  {inner}\n</{tag.split()[0]}>"
            blocks.append(" ".join(plain.split()))
        frame = ["<article>{}</article>", "<main><article class=post>{}</article></main>", "<div class='story'>{}</div>"][k % 3]
        page = f"<html><head><title>x</title></head><body><header><a href=/>Site</a></header>{gone[0].format(word())}{frame.format(html)}{gone[7].format(word())}</body></html>"
        rows.append((k, f"http://host{k % 3}.org/{k}", page))
        want[k] = "\n\n".join(b for b in blocks if b)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, _paths string, _host string").repartition(3)
    out = ex.extract(df)
    assert out.columns == ["page_id", "url", "html", "_paths", "_host", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert [k for k in want if got[k] != want[k]] == []
