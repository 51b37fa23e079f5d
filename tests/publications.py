"""A publication of our own with one defect of each kind, as entries of a package."""

from __future__ import annotations

import io
import zipfile

OPS = 'xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"'


def page(body: str, lang: str = ' xml:lang="en"') -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?><html {OPS}{lang}><head><title>t</title></head><body>{body}</body></html>'


CHAPTERS = {
    "one.xhtml": page(
        '<section epub:type="chapter"><h1 id="start">Harbour</h1><p>Boats come in.<img src="i.png"/></p><p><img src="j.png" alt=""/></p>'
        '<h2 id="tide">Tide</h2><h4>Moon</h4><p id="tide">again</p><a href="two.xhtml#none">lost</a><a href="nowhere.xhtml">gone</a>'
        '<a href="two.xhtml#loom">fine</a><a href="http://example.org/#x">out</a><a href="#tide">here</a></section>'
    ),
    "two.xhtml": page(
        '<h1 id="loom">Loom</h1><table><tr><td><b>Yarn</b></td><td><b>Weight</b></td></tr><tr><td>wool</td><td scope="row">2</td></tr></table>'
        '<table><caption>Shades</caption><tr><th id="a">A</th><th id="b" scope="col" colspan="2">B</th></tr><tr><th scope="row" rowspan="2">r</th><td headers="a zz loom">1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>'
        '<table role="presentation"><tr><td>layout</td></tr></table>'
        '<table><caption>Loop</caption><tr><th id="m" headers="n">M</th><th id="n" headers="m">N</th></tr><tr><td id="v">v</td><td headers="v">w</td></tr></table>',
        lang="",
    ),
    "three.xhtml": page(
        '<h1 id="three">Lists</h1><p>1. thread</p><h3>pause</h3><p>2. needle</p><p>3. cloth</p><p>No marker</p><p>• red</p><p style="margin-left: 3em">• green</p><p style="margin-left: 1em">• blue</p>'
        '<ul></ul><ol><ol><li>deep</li></ol><p>stray</p></ol><ol start="x"><li value="y">1. one</li><li>7. seven</li><li value="9">8. eight</li></ol>'
        '<ul><li>a</li></ul><ul><li>b</li></ul><h2>break</h2><ul><li>c</li></ul><div><li>loose</li><li>free</li></div><p>1.5 metres</p><p>a) tar<br/>b) <i>pitch</i><br/>and oil</p><p>a) one<br/>c) three</p>'
    ),
    "four.xhtml": page(
        '<h1>Notes</h1><p>Said<a epub:type="noteref" id="r1" href="#n1">[1]</a> and<a epub:type="noteref" href="#n2">[2]</a> or<a epub:type="noteref" id="r3" href="http://example.org/n">[3]</a>'
        ' yet<a epub:type="noteref" id="r4" href="#plain">[4]</a> also<a id="r5" href="#n1">[1]</a> once<sup>[6]</sup> more<sup>[7]</sup></p><p id="plain">plain</p>'
        '<section epub:type="footnotes"><aside epub:type="footnote" id="n1">1. First <a href="#r1">back</a></aside><aside epub:type="footnote" id="n2">2. Second <a href="http://example.org">site</a></aside>'
        '<aside epub:type="footnote" id="n9">2. Twin</aside><div id="n6">6. Sixth</div><div id="n7">7. Seventh</div><ul><li>just an item</li></ul>'
        '<aside epub:type="footnote" id="n8">8. Outer <aside epub:type="footnote" id="n8b">9. Inner</aside><a epub:type="noteref" id="r8" href="#n8">[8]</a></aside></section>'
    ),
    "five.xhtml": page('<h1 id="five">Afar</h1><p>See<a epub:type="noteref" id="q1" href="four.xhtml#n1">[1]</a></p><section epub:type="footnotes"><aside epub:type="footnote" id="own">1. Own</aside></section>'),
}
NAV = page(
    '<nav epub:type="landmarks"><a href="one.xhtml">Begin</a></nav><nav epub:type="toc"><ol><li><a href="two.xhtml#loom">Loom</a></li><li><a href="one.xhtml">Harbour</a></li>'
    '<li><a href="three.xhtml#three">Lists</a></li><li><a href="four.xhtml">Notes</a></li></ol></nav>'
)
CONTAINER = '<?xml version="1.0"?><container><rootfiles><rootfile full-path="text/book.opf"/></rootfiles></container>'


def opf() -> str:
    items = "".join(f'<item id="c{i}" href="{name}" media-type="application/xhtml+xml"/>' for i, name in enumerate(CHAPTERS))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(CHAPTERS))) + '<itemref idref="absent"/>'
    return (
        '<?xml version="1.0"?><package xmlns:dc="d"><metadata><dc:title>Small Trades</dc:title></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>'
    )


def files() -> dict[str, bytes]:
    out = {"mimetype": b"application/epub+zip", "META-INF/container.xml": CONTAINER.encode(), "text/book.opf": opf().encode(), "text/nav.xhtml": NAV.encode()}
    return out | {f"text/{name}": text.encode() for name, text in CHAPTERS.items()}


def package() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files().items():
            z.writestr(name, content)
    return out.getvalue()
