"""Column functions over notes and transcripts: types, scopes, titles, tags, links, slugs, JSON."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda a plain column would be computed for each element."""
    return F.transform(F.array(value), use)[0]


HEADER_TAG = r"(?m)^#{2,3}[ \t]+([^\r\n]+)$"
LINK = r"\[[^\]]*\]\(([^)]+)\)"
#: What a first message may open with.
GREETINGS = ("hey", "hi", "hello", "please", "can you", "could you", "i want to", "i need to", "help me")


def infer_type(front: Column, source_type: Column, filename: Column) -> Column:
    """Atom type by frontmatter, then by source, then by file-name prefix."""
    return (
        F.when(front.isin("task", "feedback", "reference"), front)
        .when(front == "project", "project_note")
        .when(source_type == "agent_def", "agent")
        .when(source_type == "skill_def", "skill")
        .when(source_type == "plan_file", "plan")
        .when(filename.startswith("feedback_"), "feedback")
        .when(filename.startswith("reference_"), "reference")
        .when(filename.startswith("project_"), "project_note")
        .otherwise("memory")
    )


def infer_scope(atom_type: Column, source_type: Column) -> Column:
    """Global for agents, skills and feedback, else project; shared is never inferred."""
    return F.when(source_type.isin("agent_def", "skill_def") | (atom_type == "feedback"), "global").otherwise("project")


def path_source_type(path: Column) -> Column:
    """Source type of a changed file by what its path contains; agents before skills before plans."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(p.contains("/agents/"), "agent_def").when(p.contains("/skills/"), "skill_def").when(p.contains("/plans/"), "plan_file").otherwise("memory_file")


def path_project(path: Column, root: str = "projects") -> Column:
    """The first folder under the projects root; null outside it."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/){root}/([^/]+)/", 1), F.lit(""))


def header_tags(body: Column, longest: int = 40) -> Column:
    """Second- and third-level headings of at most ``longest`` characters, lower-cased, first seen first."""
    heads = F.transform(F.regexp_extract_all(body, F.lit(HEADER_TAG), F.lit(1)), lambda h: F.trim(h))
    return F.array_distinct(F.transform(F.filter(heads, lambda h: (F.length(h) <= longest) & (h != "")), lambda h: F.lower(h)))


def tags(front_tags: Column, front_keywords: Column, body: Column) -> Column:
    """Frontmatter tags and keywords, then headings; lower-cased, each once."""
    empty = F.array().cast("array<string>")
    given = F.transform(F.concat(F.coalesce(front_tags, empty), F.coalesce(front_keywords, empty)), lambda t: F.lower(t))
    return F.array_distinct(F.concat(given, header_tags(body)))


def link_targets(body: Column) -> Column:
    """Targets of markdown links and images that are neither web addresses, anchors nor mail addresses."""
    found = F.regexp_extract_all(body, F.lit(LINK), F.lit(1))
    return F.filter(found, lambda t: ~(t.startswith("http") | t.startswith("#") | t.startswith("mailto:")))


def derive_title(section: Column, name: Column, title: Column, body: Column, filename: Column, index: Column) -> Column:
    """Section heading (with the file name in front after the first), else name, title, first H1, file name."""
    blank = lambda c: F.nullif(c, F.lit(""))
    h1 = blank(F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+([^\r\n]+)$", 1)))
    prefixed = F.when(index > 0, F.concat(filename, F.lit(": "), section)).otherwise(section)
    return F.coalesce(F.when(blank(section).isNotNull(), prefixed), blank(name), blank(title), h1, filename)


def generate_title(first: Column) -> Column:
    """A short title from a first message: one greeting dropped, capitalised, cut at a sentence, then at a word."""
    t = F.regexp_replace(F.coalesce(first, F.lit("")), r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"^(?i)(" + "|".join(GREETINGS) + r")\s+", "")
    t = F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))
    end = F.length(F.regexp_extract(t, r"^([^.!?\n]*)[.!?\n]", 1))
    t = F.when(t.rlike(r"[.!?\n]") & (end > 0) & (end <= 80), F.left(t, end)).otherwise(t)
    head = F.left(t, F.lit(61))
    cut = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(head.contains(" "), cut).otherwise(F.lit(-1))
    t = F.when(F.length(t) > 65, F.concat(F.left(t, F.when(cut > 20, cut).otherwise(F.lit(60))), F.lit("..."))).otherwise(t)
    return F.when(F.coalesce(first, F.lit("")) == "", "Untitled session").otherwise(t)


def slug(title: Column, mark: str = "_") -> Column:
    """Lower-cased, runs of other characters than a-z and 0-9 as one mark, one mark trimmed at each end."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", mark), f"^{mark}|{mark}$", "")


def path_slug(cwd: Column) -> Column:
    """A working directory as a project slug."""
    return F.regexp_replace(F.regexp_replace(cwd, r"[:\\/]", "-"), "^-+|-+$", "")


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def strip_frontmatter(raw: Column) -> Column:
    """The text after a leading ``---`` block, left-trimmed."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?s)^---[\r\n].*?[\r\n]---[\r\n]?", ""), r"^\s+", "")


def frontmatter_block(raw: Column) -> Column:
    """The leading ``---`` block's text, or null."""
    return F.nullif(F.regexp_extract(raw, r"(?s)^---[\r\n](.*?)[\r\n]---", 1), F.lit(""))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks with marks and what is left without them, by Unicode decomposition."""
    a, b = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            a.append(chr(code))
            b.append(base[0])
    return "".join(a), "".join(b)


ACCENTED, PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    """Words of letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
