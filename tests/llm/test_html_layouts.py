"""Pages of several layouts, marked by hand, and pages whose mark-up is not what it seems."""

from collections import Counter, defaultdict

import pytest

from netlattice.llm.html_wrapper import Reading, main_text

TOPICS = ["ferns", "tides", "kilns", "moths", "looms", "gears"]
WIDE = "We keep this note below every page of ours so that all who read here know our terms and our house rules. " * 6


def layouts(topic, k):
    """layout -> (html, main text); no class, id or role tells what is what."""
    story = f"An account of {topic}, number {k}, which stands on no other page. " * 2
    said = [f"Reader {i} on {topic}: I have seen {i * k + 3} of them, and I do not agree with what is said above, not in the least, {topic} or no {topic}." for i in range(2 + k % 4)]
    thread = "".join(f'<div class="m1"><b>Reader {i}</b><p>{s}</p></div>' for i, s in enumerate(said))
    whole = f"On {topic} {story}"
    return {
        "short article, long thread": (f'<body><article><h1>On {topic}</h1><p>{story[:60]}</p></article><div class="m0">{thread}</div></body>', f"On {topic} {story[:60]}"),
        "thread of articles": (f'<body><div class="a1"><h1>On {topic}</h1><p>{story}</p><p>{story}</p></div><div class="m0">{"".join(f"<article>{s}</article>" for s in said)}</div></body>', f"{whole} {story}"),
        "teasers that vary": (f'<body><div class="a1"><h1>On {topic}</h1><p>{story}</p></div><div class="b1"><article><a href=/{k}>More on {topic}</a></article><article><a href=/x{k}>Also on {topic}</a></article></div></body>', whole),
        "share bar inside": (f'<body><article><h1>On {topic}</h1><div class="c1">Tell <a href=#a>a friend</a> or <a href=#b>the town</a></div><p>{story}</p><h2>Sources</h2><p>Own work on {topic}</p></article></body>', f"{whole} Sources Own work on {topic}"),
        "sign-up inside, without a form": (f'<body><article><h1>On {topic}</h1><p>{story}</p><div class="c2"><p>Have our letter sent to you each week</p><p>Your post address</p></div></article></body>', whole),
        "all in one form, with a note": (f'<body><form id="f0" action="/"><input type=hidden><div class="a1"><h1>On {topic}</h1><p>{story}</p><div class="c2">We use small files to know you again</div></div><select><option>one</select></form></body>', whole),
        "terms longer than the story": (f'<body><div class="a1"><h1>On {topic}</h1><p>{story}</p></div><div class="d1"><p>{WIDE}</p></div></body>', whole),
        "long list of places": (f'<body><div class="e1"><ul>{"".join(f"<li><a href=/{p}>{p} and all of its surroundings</a></li>" for p in range(40))}</ul><p>{WIDE}</p></div><div class="a1"><h1>On {topic}</h1><p>{story}</p></div></body>', whole),
        "menu never closed": (f'<body><nav><ul><li>Home<li>Shop</ul><article><h1>On {topic}</h1><p>{story}</p><div class="c3">See <a href=/r>our rules</a> first</div></article></body>', whole),
    }


MARKED = [(f"http://l{n}.example/{k}", name, page, text) for k, topic in enumerate(TOPICS) for n, (name, (page, text)) in enumerate(layouts(topic, k).items())]


def words_right(found, wanted):
    common = sum((Counter(found.split()) & Counter(wanted.split())).values())
    return common / max(1, len(found.split())), common / max(1, len(wanted.split()))


def test_layouts(spark):
    """Precision and recall in words, per layout, with the wrapper; without it most layouts fall short."""
    pages = spark.createDataFrame([(k, url, page) for k, (url, _, page, _) in enumerate(MARKED)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    with_it, without = defaultdict(list), defaultdict(list)
    for k, (_, name, page, text) in enumerate(MARKED):
        with_it[name].append(words_right(found[k], text))
        without[name].append(words_right(Reading(None).text(page), text))
    for name, scores in with_it.items():
        assert all(sum(s) / len(s) > 0.98 for s in zip(*scores, strict=True)), (name, scores)
    worse = [name for name, scores in without.items() if any(sum(s) / len(s) < 0.9 for s in zip(*scores, strict=True))]
    assert len(worse) >= 6, worse


def test_a_wrapper_takes_no_whole_article(spark):
    """Copies of one article under several addresses are constant; they are text for all that."""
    page = '<body><article><h1>Rain</h1><p>It <a href=/w>rained</a> all day long.</p></article><div class="x">{}</div></body>'
    pages = spark.createDataFrame([(k, f"http://copies.example/{k}", page.format(k)) for k in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in main_text(pages).collect()} == {"Rain It rained all day long."}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<form id="aspnetForm"><input><article><p>in a form</p></article></form>', "in a form"),
        ('<form id="aspnetForm"><div><h1>Title</h1><p>all of the page</p></div><button>Go</button></form>', "Title all of the page"),
        ("<div><p>the text of this page</p><form><p>Your name</p><input></form></div>", "the text of this page"),
        ("<nav><ul><li>Home</li></ul><article>kept</article>", "kept"),
        ("<body><aside><p>beside</p><section><h1>Head</h1><p>text</p></section></body>", "Head text"),
        ("<nav><a href=/>x</a><article>teaser</article></nav><div><p>own text</p></div>", "own text"),
        ("<body><header><p>site</p><nav>m<main>deep</main></body>", "deep"),
        ("<article><p>Let <math><mi>x</mi></math> be odd.</p><xmp>a < b & c</xmp></article>", "Let x be odd. a < b & c"),
        ('<article><ul class="menu"><li>Soup<li>Bread</ul><p class="notice">Closed on Monday</p><p class="comment">As Kant says</p><p role="note">Mind</p></article>', "Soup Bread Closed on Monday As Kant says Mind"),
        ('<article><ul class="menu"><li><a href=/s>Start</a><li><a href=/e>End</a></ul><p>text</p><ol class="commentlist"><li>first!</ol><div class="ad">buy</div></article>', "text"),
        ('<article><p>Press <button>Stop</button> now</p></article><button>Top</button>', "Press Stop now"),
    ],
)
def test_mark_up_that_misleads(page, text):
    assert Reading(None).text(page) == text
