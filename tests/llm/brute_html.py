"""Blocks of well-formed pages by the standard library's parser, and kept blocks of a host's pages by a dictionary of all runs."""

from html.parser import HTMLParser

from quarryline.llm.htmltext import ARTICLE, MARKED, RUN, UNMARKED


def clean(pages):
    mains, words, grams = [], [], {}
    for blocks in pages:
        wanted = ARTICLE if any(z == ARTICLE for z, _ in blocks) else UNMARKED
        mains.append((wanted, tuple(t for z, t in blocks if z == wanted)))
        words.append([(z, b, w) for b, (z, t) in enumerate(blocks) for w in t.split(" ")])
    for p, some in enumerate(words):
        for i in range(len(some) - RUN + 1):
            run = some[i : i + RUN]
            if len({z for z, *_ in run}) == 1:
                grams.setdefault(tuple(w for *_, w in run), []).append((p, i, run[0][0]))
    out = []
    for p, blocks in enumerate(pages):
        wanted, gone = mains[p][0], set()
        for at in grams.values():
            counted = [(q, z) for q, _, z in at if wanted == UNMARKED or z != MARKED]
            if len({mains[q][1] for q, _ in counted}) > 1 and any(z == UNMARKED for _, z in counted):
                gone |= {i + k for q, i, _ in at if q == p for k in range(RUN)}
        kept, lo = [], 0
        for z, text in blocks:
            n = text.count(" ") + 1
            mine = [i in gone for i in range(lo, lo + n)]
            lo += n
            if z != wanted:
                continue
            if not all(mine):  # runs shorter than RUN only reach over from the next block
                i = 0
                while i < n:
                    j = next((j for j in range(i, n) if mine[j] != mine[i]), n)
                    if mine[i] and j - i < RUN:
                        mine[i:j] = [False] * (j - i)
                    i = j
            if not any(mine) or z == ARTICLE and not all(mine):
                kept.append(text)
            elif not all(mine):
                kept.append(" ".join(w for w, g in zip(text.split(" "), mine, strict=True) if not g))
        out.append(kept)
    return out


class Zones(HTMLParser):
    """Pages whose elements are all closed, but for p and br, and whose class names are single words."""

    BLOCKS = frozenset("html body head nav div article section aside footer header main ul ol li p h1 h2 h3 form table tr td blockquote".split())
    MARKS = frozenset("head nav footer aside form".split())
    NAMES = frozenset("ad sidebar related comments cookie".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.out, self.skip = [], [], [], 0

    def flush(self):
        joined = " ".join("".join(self.text).split())
        if joined:
            inside = [name for name, _ in self.open]
            marked = any(m for _, m in self.open)
            self.out.append((MARKED if marked else ARTICLE if {"article", "main"} & set(inside) else UNMARKED, joined))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in self.BLOCKS:
            self.flush()
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
        if tag in ("script", "style", "title"):
            self.skip += 1
        if tag not in ("br", "meta", "img", "link"):
            attrs = dict(attrs)
            self.open.append((tag, tag in self.MARKS or attrs.get("class") in self.NAMES or attrs.get("id") in self.NAMES))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        if tag in self.BLOCKS:
            self.flush()
        if tag in [name for name, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def zones_of(page):
    parser = Zones()
    parser.feed(page)
    parser.close()
    parser.flush()
    size = {z: sum(len(t) for y, t in parser.out if y == z) for z in (ARTICLE, UNMARKED)}
    return [(UNMARKED if z == ARTICLE and size[ARTICLE] < size[UNMARKED] else z, t) for z, t in parser.out]
