"""Pages on which marks and the distribution of text disagree."""

from lumenfold.llm.html_extract import extract

LONG = ("word " * 40).strip()
LINKS = "".join(f"<p><a href=x>link number {k}</a>" for k in range(3))


def test_an_unmarked_body_beside_a_marked_teaser():
    assert extract(f"<article>Teaser.</article><div><p>{LONG}<p>{LONG}</div>") == "\n\n".join(["Teaser.", LONG, LONG])
    assert extract(f"<div>{LONG}</div>{LINKS}<article>Late.</article>") == "\n\n".join([LONG, "Late."])


def test_marks_refine_edges():
    assert extract(f"<p>by the site<article><p>Of.<p>So.<p>It.<p>{LONG}<p>End.</article><p>note") == "\n\n".join(["Of.", "So.", "It.", LONG, "End."])


def test_short_articles():
    assert extract("<body><p>A short one.<p>It ends here.</body>") == "A short one.\n\nIt ends here."
    assert extract("<main>word</main><p>not this") == "word"
    assert extract("<p>word") == extract(LINKS) == ""


def test_lines_of_links_inside_the_text():
    assert extract(f"<p>{LONG}<p><a href=x>a linked line</a><p>{LONG}") == "\n\n".join([LONG, "a linked line", LONG])
    assert extract(f"<p>{LONG}{LINKS}<p>{LONG}") == "\n\n".join([LONG, LONG])
