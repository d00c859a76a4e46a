"""Pages with tags left out, and wrappers named like what stands beside the text."""

import time

import pytest

from boxmill.llm import html_cut

STORY = "The first sentence of a story that goes on for quite a while, with " + "many words in it and " * 10 + "an end."
ARTICLE = f"<article><h1>Title</h1><p>{STORY}</p></article>"
TEXT = f"Title\n{STORY}"


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><meta charset=utf-8><body>{}</body></html>",
    "<html><head><title>T</title>{}</html>",
    "<html><head><title>T</title><script>for (i=0;i<n;i++) s='it\\'s'; t = \"'\"</script></head><body>{}</body></html>",
    "<head><script>if (i<n) say('<head>')</script><style>a:after{{content:'<head>'}}</style></head><body>{}",
    "<head><script>x = 'i<n it'</script><script>y<z'</script></head><body>{}",
    "<head><template><div>hidden words</div></template><title>a <b> c</title></head><body>{}",
    "<body><datalist><option>one<option>two</datalist>{}",
    "<body><option>one{}",
    "<body><div><button>Send</div>{}",
    "<body><button>Send{}<button>More</button>",
    "<body><button><div>Send</div> it</button>{}",
    "<body><div><select><option>one<option>two</div>{}",
    "<body><div><svg><path d=x></div>{}",
    "<body><svg><title>a</title><style>a<b'</style></svg>{}",
    "<body><object><script>if (a<b) '</object></script></object>{}",
])
def test_tags_left_out(page):
    assert html_cut.main_text(page.format(ARTICLE)) == TEXT


def test_buttons_and_head_are_not_text():
    page = f"<head><title>Some words of a title.</title></head><body><button>Words of a button that is long enough to be a text.</button>{ARTICLE}"
    assert html_cut.main_text(page) == TEXT
    assert [b.text for b in html_cut.blocks("<head> words <p>more<button>no<b>t</b></button> of them")] == ["words", "more of them"]


COMMENTS = "".join(f"<article class='comment-body'><p>Reader {k} has a lot to say about all of this, as always, at some length.</p></article>" for k in range(20))
CARDS = "".join(f"<article class=card><h3>Another story {k}</h3><p>This one is about something else, which is well worth a visit.</p></article>" for k in range(3))
CHROME = "<nav>" + "".join(f"<li><a href=x>Part {k} of the menu</a>" for k in range(60)) + "</nav>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout with-sidebar", "post category-legal", "page has-header"])
@pytest.mark.parametrize("body", [ARTICLE, f"<h1>Title</h1><p>{STORY}</p>", f"<main><h1>Title</h1><p>{STORY}</p></main>", f"<div role=main><h1>Title</h1><p>{STORY}</p></div>"])
def test_wrappers_with_side_names(name, body):
    assert html_cut.main_text(f"<body><div class='{name}'>{body}</div></body>") == TEXT
    beside = "<div class=sidebar><p>Something else that stands beside the story of the page.</p></div>"
    assert html_cut.main_text(f"<body><div class='{name}'>{body}{beside}</div></body>") == TEXT
    if body[1] != "h":
        assert html_cut.main_text(f"<body>{CHROME}<div class='{name}'>{body}</div></body>") == TEXT


def test_comments_and_teasers_stay_out():
    assert html_cut.main_text(f"{ARTICLE}<div id=comments>{COMMENTS}</div>") == TEXT
    assert html_cut.main_text(f"{ARTICLE}<div class=related>{CARDS}</div>") == TEXT
    assert html_cut.main_text(f"<div class=has-sidebar>{ARTICLE}<div class=related>{CARDS}</div><div id=comments>{COMMENTS}</div></div>") == TEXT
    assert html_cut.main_text(f"<div class=post><h1>Title</h1><p>{STORY}</p></div><div id=comments>{COMMENTS}</div>") == TEXT


def test_time_grows_with_the_page_alone():
    # a million tags that end nothing, below a thousand open elements
    page = "<div>" * 1000 + "<article><p>" + "word " * 30 + "</ul></q1x>" * 500_000 + "</article><svg>" + "<script>" * 100_000
    start = time.process_time()
    assert html_cut.main_text(page) == ("word " * 30).strip()
    assert time.process_time() - start < 60
