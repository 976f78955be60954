"""Parsers of bibliographies: BibTeX, LaTeX, plain text and TEI XML, as pure functions on one file's text."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET

#: Combining marks of LaTeX accent commands, and its letters (fixed values).
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
LETTERS = {r"\ss": "ß", r"\o": "ø", r"\O": "Ø", r"\l": "ł", r"\L": "Ł", r"\ae": "æ", r"\AE": "Æ", r"\aa": "å", r"\AA": "Å", r"\i": "i"}
_ACCENT = re.compile(r"\\(['`^\"~=.]|[cvuHkr](?=[{\s]))\s*\{?\\?([A-Za-z])\}?")
_YEAR = re.compile(r"\b((?:19|20)\d\d)\b")
_DOI = re.compile(r"10\.\d{4,9}/[^\s,;]+")
_HEADING = re.compile(r"^\s*(?:references|bibliography|works cited|literature cited)\s*$", re.I | re.M)
_CITE = re.compile(r"\\(?:no)?cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def unlatex(text: str) -> str:
    """Accent commands to letters, braces away."""
    for command in sorted(LETTERS, key=len, reverse=True):
        text = re.sub(re.escape(command) + r"(?![A-Za-z])", LETTERS[command], text)
    text = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m[2] + ACCENTS[m[1]]), text)
    return re.sub(r"\s+", " ", text.replace("{", "").replace("}", "").replace("\\&", "&")).strip()


def group(text: str, at: int) -> int:
    """The end of the brace group that opens at `at`; the text's end if it never closes."""
    depth = 0
    for k in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if depth == 0:
            return k + 1
    return len(text)


def bib_fields(body: str) -> dict[str, str]:
    found, at = {}, 0
    while m := re.compile(r"\s*,?\s*([A-Za-z_-]+)\s*=\s*").match(body, at) or re.compile(r",\s*([A-Za-z_-]+)\s*=\s*").search(body, at):
        at = m.end()
        if at < len(body) and body[at] == "{":
            end = group(body, at)
            value = body[at + 1 : end - 1]
        elif at < len(body) and body[at] == '"':
            end = body.find('"', at + 1) % (len(body) + 1) + 1
            value = body[at + 1 : end - 1]
        else:
            end = (re.compile(r"[,\n}]").search(body, at) or re.compile(r"$").search(body, at)).start()
            value = body[at:end]
        found[m[1].lower()] = value.strip()
        at = end
    return found


def name(person: str) -> str:
    """Last, First becomes First Last."""
    last, comma, first = person.partition(",")
    return f"{first.strip()} {last.strip()}".strip() if comma else person.strip()


def raw_text(authors: list[str], year: int | None, title: str, venue: str | None) -> str:
    people = ", ".join(authors[:3]) + (" et al." if len(authors) > 3 else "")
    return f"{people}. ({year or 'n.d.'}). {title}." + (f" {venue}" if venue else "")


def bibtex(text: str) -> list[dict]:
    """References of a .bib file; entries without a title are left out."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        fields = {k: unlatex(v) for k, v in bib_fields(text[m.end() : group(text, text.index("{", m.start())) - 1]).items()}
        if not fields.get("title"):
            continue
        authors = [name(x) for x in re.split(r"\s+and\s+", fields.get("author", "")) if x.strip()]
        year = int(y[0]) if (y := re.search(r"\d{4}", fields.get("year", ""))) else None
        venue = fields.get("journal") or fields.get("booktitle") or fields.get("publisher")
        out.append({"ref_id": m[2], "title": fields["title"], "authors": authors, "year": year, "venue": venue, "doi": fields.get("doi"), "url": fields.get("url") or fields.get("howpublished") or fields.get("note"), "raw_text": raw_text(authors, year, fields["title"], venue)})
    return out


def plain_references(text: str) -> list[dict]:
    """References of the section under the first heading; ids count entries before short ones go."""
    heading = _HEADING.search(text)
    if not heading:
        return []
    section = text[heading.end() :].strip()
    entries = re.split(r"\n(?=\s*(?:\[\d+\]|\d+\.)\s)", section) if re.search(r"^\s*(?:\[\d+\]|\d+\.)\s", section, re.M) else re.split(r"\n\s*\n", section)
    out = []
    for k, entry in enumerate(entries, 1):
        whole = re.sub(r"\s+", " ", entry).strip()
        if len(whole) < 10:
            continue
        bare = re.sub(r"^(?:\[\d+\]|\d+\.)\s*", "", whole)
        year, doi = _YEAR.search(bare), _DOI.search(bare)
        title = re.search(r'["“]([^"”]+)["”]', bare)
        if title:
            found = title[1]
        elif year and (after := re.match(r"[).\s]*([^.]+)\.", bare[year.end() :])):
            found = after[1]
        else:
            found = max(bare.split(". "), key=len)
        before = bare[: year.start()] if year else bare.partition(".")[0]
        authors = [x.strip(" .(") for x in re.split(r",\s*(?:and\s+)?(?=[A-Z][a-z])|\s+and\s+|;|&", before) if len(x.strip(" .(")) > 1]
        out.append({"ref_id": str(k), "title": found.strip(" .,"), "authors": authors, "year": int(year[1]) if year else None, "venue": None, "doi": doi[0].rstrip(".") if doi else None, "url": None, "raw_text": whole})
    return out


def latex_citations(text: str) -> list[dict]:
    """One row for each key of each citation command, with the sentences around it."""
    clean = re.sub(r"(?<!\\)%[^\n]*", "", text)
    out = []
    for m in _CITE.finditer(clean):
        low = clean.rfind("\n\n", 0, m.start()) + 2 if clean.rfind("\n\n", 0, m.start()) >= 0 else 0
        high = clean.find("\n\n", m.end()) if clean.find("\n\n", m.end()) >= 0 else len(clean)
        at, sentences = 0, _SENTENCE.split(clean[low:high])
        ends = []
        for s in sentences:
            at = clean.index(s, low + at) - low + len(s)
            ends.append(at)
        own = next((k for k, e in enumerate(ends) if m.start() - low < e), len(sentences) - 1)
        tidy = lambda xs: unlatex(" ".join(re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])*\{([^}]*)\}", r"[\1]", x) for x in xs))
        for key in filter(None, map(str.strip, m[1].split(","))):
            out.append({"ref_id": key, "citing_sentence": tidy(sentences[own : own + 1]), "context_before": tidy(sentences[max(0, own - 2) : own]), "context_after": tidy(sentences[own + 1 : own + 2]), "marker": m[0], "position": m.start()})
    return out


def _text(node: ET.Element | None) -> str | None:
    return None if node is None else re.sub(r"\s+", " ", "".join(node.itertext())).strip() or None


def tei_references(xml: str) -> list[dict]:
    """References of a TEI document's bibliography, those with an identifier, or with a year and authors or a title."""
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", xml, count=1))
    out = []
    for node in root.iterfind(".//listBibl/biblStruct"):
        title = _text(node.find("analytic/title[@level='a']")) or _text(node.find("monogr/title")) or _text(node.find(".//title"))
        title = re.sub(r"\s*arXiv preprint.*$|\s*//.*$", "", title) if title else None
        authors = [" ".join(filter(None, (_text(x) for x in person.iter() if x.tag in ("forename", "surname")))) for person in node.iterfind(".//author/persName")]
        date = node.find(".//date")
        year = re.search(r"\d{4}", (date.get("when") or _text(date) or "") if date is not None else "")
        ids = {(x.get("type") or "").lower(): _text(x) for x in node.iterfind(".//idno")}
        pointer = node.find(".//ptr")
        raw = _text(node.find("note[@type='raw_reference']")) or ""
        doi = ids.get("doi") or ids.get("arxiv")
        if doi or (year or _YEAR.search(raw)) and (authors or len(title or "") > 5):
            out.append({"ref_id": str(len(out) + 1), "title": title, "authors": authors, "year": int(year[0]) if year else None, "venue": _text(node.find("monogr/title[@level='j']")) or _text(node.find("monogr/title[@level='m']")), "doi": doi, "url": pointer.get("target") if pointer is not None else ids.get("uri"), "raw_text": raw})
    return out


#: An author in a marker (with particles), the year, and the forms that markers take.
_AUTHOR = r"(?:(?:[Dd]e|[Vv]an|[Vv]on|[Dd]er|[Dd]i|[Ll]a|[Ll]e|[Aa]l|[Bb]in)\s+)*[A-Z][\w'’-]+"
_YEARS = r"(?:1[89]|20|21)\d\d[a-z]?"
_NUMBERED = re.compile(r"\[(\d+(?:\s*[-,]\s*\d+)*)\]")
_PAREN = re.compile(rf"[(\[]({_AUTHOR}[^()\[\]]*?,?\s*{_YEARS}(?:\s*[;,][^()\[\]]*?{_YEARS})*)[)\]]")
_NARRATIVE = re.compile(rf"({_AUTHOR}(?:\s+et\s+al\.?|\s+(?:and|&)\s+{_AUTHOR})?)\s*[(\[]({_YEARS})[)\]]")
_NOT_BEFORE = re.compile(r"(?:Table|Figure|Fig\.|Eq\.|Equation|Section|[=<>+*/^])\s*$")


def numbers(inner: str) -> list[str]:
    """1-3, 5 becomes 1 2 3 5; a range of more than a hundred is its start, one that runs backwards nothing."""
    out: list[str] = []
    for part in map(str.strip, inner.split(",")):
        low, dash, high = (x.strip() for x in part.partition("-"))
        if dash and low.isdigit() and high.isdigit():
            out += [low] if int(high) - int(low) > 100 else map(str, range(int(low), int(high) + 1))
        elif part.isdigit():
            out.append(part)
    return out


def key(author: str, year: str) -> str:
    first = re.split(r"\s+and\s+|&|,|\s+et\s+al", author.strip(), maxsplit=1)[0]
    return re.sub(r"[-.'’\s]", "", first.split()[-1].lower()) + ("etal" if re.search(r"et\s+al", author) else "") + year


def markers(text: str) -> list[dict]:
    """Markers in order, the longest first where they start together, none that overlaps an earlier one."""
    found = []
    for m in _NUMBERED.finditer(text):
        if not _NOT_BEFORE.search(text[max(0, m.start() - 12) : m.start()]) and not m[1].startswith("0") and text[: m.start()].count("$") % 2 == 0 and not re.search(r"(?:^|\n)\s*$", text[: m.start()]):
            found.append((m.start(), m[0], numbers(m[1])))
    for m in _PAREN.finditer(text):
        keys = []
        for part in m[1].split(";"):
            years = re.findall(_YEARS, part)
            author = re.split(_YEARS, part, maxsplit=1)[0].strip(" ,")
            keys += [key(author, y) for y in years] if re.match(_AUTHOR, author) else []
        if keys:
            found.append((m.start(), m[0], keys))
    for m in _NARRATIVE.finditer(text):
        found.append((m.start(), m[0], [key(m[1], m[2])]))
    out, end = [], 0
    for at, marker, keys in sorted(found, key=lambda x: (x[0], -len(x[1]))):
        if at >= end and keys:
            out.append({"marker": marker, "keys": keys, "position": at})
            end = at + len(marker)
    return out


def canonical_author(person: str) -> tuple[str, str]:
    """Surname and initial of Huang, H. - Huang H - H. Huang - Hai Huang."""
    whole = person.strip().replace(".", " ")
    last, comma, first = whole.partition(",")
    words = whole.split()
    if not comma and len(words) > 1 and re.fullmatch(r"[A-Z]{1,3}", words[-1]):
        last, first = " ".join(words[:-1]), words[-1]
    elif not comma:
        last, first = (words[-1], " ".join(words[:-1])) if words else ("", "")
    return re.sub(r"[-'\s]", "", last.lower()), first.strip()[:1].lower()


def match_authors(reference: list[str], record: list[str]) -> list[int]:
    """For each author of a reference the best unused one of a record by its place, -1 if none: surname and initial before surname with an initial missing."""
    own, free = [canonical_author(x) for x in record], set(range(len(record)))
    out = []
    for surname, initial in map(canonical_author, reference):
        ranked = [(-(2 if initial and initial == own[k][1] else 1), k) for k in sorted(free) if own[k][0] == surname and (initial == own[k][1] or not initial or not own[k][1])]
        out.append(min(ranked)[1] if ranked else -1)
        free.discard(out[-1])
    return out


def word_differences(a: str, b: str) -> list[str]:
    """Words that differ along a longest common subsequence, from the end of the titles backwards."""
    x, y = a.split(), b.split()
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(x), len(y), []
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or table[i][j - 1] >= table[i - 1][j]):
            j -= 1
            out.append(f"+{y[j]}")
        else:
            i -= 1
            out.append(f"-{x[i]}")
    return out
