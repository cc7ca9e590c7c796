"""Cleaning, normalizing and judging of lines of text: rules over one text, as SQL expressions.

Each rule takes the dialect and the text's name; :func:`quire.functions.dialect.column` makes a Spark column of it.
"""

from __future__ import annotations

from quire.functions.dialect import CJK, WS, Spark, alternatives

# --- fixed values: word lists that results depend on -----------------------------------------------------------------
FUNCTION_WORDS = "the of and in to a is are was were for on with by as at from that this be or an which we it its not has have der die und das le la les et des el los".split()
OPEN_WORDS = "and or of the a an to in with for by from that which on at than as is are was were be its their nor".split()
WANTING_WORDS = "and or of the a an to in with for by from on at than as is are its their & vs.".split()
FRONT_HEADINGS = ["abstract", "summary", "keypoints", "keywords", "highlights", "plainlanguagesummary", "introduction", "articleinfo", "要旨", "概要", "要約", "はじめに", "序論", "緒言"]
CLOSING_HEADINGS = ["acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "appendix", "conclusions", "conclusion", "謝辞", "付録", "おわりに", "まとめ", "結論", "結語", "あとがき"]
REFERENCE_HEADINGS = ["references", "reference", "bibliography", "literature cited", "references cited", "cited literature", "works cited", "参考文献", "引用文献", "文献", "references and notes"]
REFERENCE_SECTIONS = ["references", "reference", "references cited", "cited references", "literature cited", "literature", "bibliography", "reference list", "list of references", "works cited", "references and notes", "notes and references", "selected references", "selected bibliography", "supplementary references", "supporting references", "literatur", "literaturverzeichnis", "bibliographie", "références", "referencias", "bibliografía", "bibliografia", "riferimenti", "references cited in the text", "literature references"]
TRANSLATION_REFERENCES = ["references", "reference", "bibliography", "literature cited", "references cited", "works cited", "参考文献", "引用文献", "文献"]
SECTION_WORDS = ["acknowledg", "appendix", "appendices", "supplementary", "supporting information", "supplement", "data availability", "author contributions", "funding", "conflict", "competing", "declaration", "figure captions", "figure legends", "tables", "glossary", "abbreviations", "nomenclature", "notes", "謝辞", "付録", "附録", "補遺", "注", "脚注", "索引"]
KICKERS = ["open", "open access", "article", "articles", "research article", "research articles", "review article", "original article", "original paper", "original research", "research paper", "research papers", "letter", "letters", "review", "reviews", "short communication", "short communications", "research letter", "report", "reports", "perspective", "perspectives", "correspondence", "editorial", "brief communication", "rapid communication", "full paper", "regular article", "regular paper", "technical note", "discussion", "comment", "reply", "communication", "article in press", "accepted manuscript", "article info", "論説", "総説", "短報"]
NOTE_STARTS = ["corresponding author", "*corresponding", "* corresponding", "e-mail", "email:", "email address", "received", "accepted", "editorial handling", "editorial responsibility", "handling editor", "responsible editor", "communicated by", "citation:", "present address", "current address", "tel.", "tel:", "fax:", "electronic supplementary material", "supplementary information", "additional supporting information", "orcid"]
BOILERPLATE_STARTS = ["copyright", "©", "paper number", "printed in", "contents lists available at", "journal homepage", "this article is protected by copyright", "this article has been accepted for publication", "downloaded from", "this is an open access article", "open access this article", "published by elsevier", "all rights reserved", "crown copyright"]
DATED_STARTS = ["manuscript received", "manuscript accepted", "revised manuscript", "received", "revised", "accepted", "submitted", "published online", "available online"]
CONTENTS_HEADINGS = ["contents", "content", "table of contents", "index", "subject index", "author index", "general index", "list of figures", "list of tables", "detailed contents", "brief contents", "contents in brief", "keyword index"]
COVER_WEAK = ["article in press", "accepted manuscript", "downloaded from", "downloaded by", "rights and permissions", "how to cite", "citation details", "stable url"]
COVER_STRONG = ["to cite this article", "link to published version", "link to publication record", "general rights", "take down policy", "take-down policy", "citation for published version", "please refer to any applicable terms of use", "publisher's pdf, also known as", "cite this article as", "unedited version of this manuscript", "before final publication", "to link to this article", "submit your article", "view related articles", "view crossmark data", "article views:", "full terms & conditions", "full terms and conditions", "terms and conditions of access and use", "this content downloaded", "use of this article is subject to", "view the article online", "your use of the jstor archive", "jstor is a not-for-profit", "please scroll down for article", "copyright and permissions", "the following article is", "this article may be used for"]
MATH_FONTS = ["math", "cmmi", "cmsy", "cmex", "msbm", "msam", "symbol", "stixgeneral", "stixsize", "stixintegrals", "stixvariants", "stixnonunicode", "mt extra", "mtextra", "euclid", "mathematicalpi", "txsy", "txmi", "rtxmi", "mtsy", "mtmi"]
MATH_CHARS = r"\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{1D400}-\x{1D7FF}\x{2190}-\x{21FF}\x{27C0}-\x{27EF}\x{0391}-\x{03C9}=+±×÷≤≥≈∝∞∑∏∫√∂∇"
TRIMMED_MARKS = "\\\"\\'`.,;:!?()[]{}<>«»“”‘’*†‡§¶|/\\\\=•~^_+#@$%&"  # the same for Spark's trim
WORD_MARKS = r"\x22\x27\x60.,;:!?()\[\]{}<>«»“”‘’*†‡§¶|/\\=•~^_+#@$%&"
# ---------------------------------------------------------------------------------------------------------------------


# helpers


def words(q: Spark, t: str) -> str:
    return q.all(t, f"[^{WS}]+")


def trimmed(q: Spark, t: str) -> str:
    return q.strip(t)


def left_trimmed(q: Spark, t: str) -> str:
    return q.strip(t, right=False)


def right_trimmed(q: Spark, t: str) -> str:
    return q.strip(t, left=False)


def unspaced(q: Spark, t: str) -> str:
    return q.replace(t, f"[{WS}]+")


def one_of(q: Spark, t: str, texts: list[str]) -> str:
    return f"({t} IN ({', '.join(_plain(q, x) for x in texts)}))"


def _plain(q: Spark, text: str) -> str:
    return "'" + text.replace("\\", "\\\\" if q.name == "spark" else "\\").replace("'", "\\'" if q.name == "spark" else "''") + "'"


def contains_count(q: Spark, t: str, texts: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({t}, {_plain(q, x)}) AS int)" for x in texts) + ")"


def ratio(q: Spark, part: str, whole: str, a: int, b: int) -> str:
    """part / whole >= a / b, in integers."""
    return f"({part} * {b} >= {whole} * {a})"


# 2.2 cleaning


def trim_line_spaces(q: Spark, t: str) -> str:
    """Space at the ends goes, but for an ideographic space that opens a paragraph."""
    lead = WS.replace(r"\x{3000}", "")
    return q.replace(q.replace(t, f"[{WS}]+$"), f"^[{lead}]+")


def drop_control(q: Spark, t: str) -> str:
    """Control characters other than tabs go."""
    return q.replace(t, r"[\x{00}-\x{08}\x{0A}-\x{1F}\x{7F}-\x{9F}]+")


def drop_zero_width(q: Spark, t: str) -> str:
    return q.replace(t, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]+")


def plain_spaces(q: Spark, t: str) -> str:
    """Exotic spaces become plain ones."""
    return q.replace(t, r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}]", " ")


def drop_soft_hyphens(q: Spark, t: str) -> str:
    return q.replace(t, r"\x{AD}")


def is_junk(q: Spark, t: str) -> str:
    """Nothing but replacement characters, private-use characters and controls."""
    return q.has(t, r"^[\x{FFFD}\x{E000}-\x{F8FF}\x{00}-\x{1F}\x{7F}-\x{9F}]+$")


def japanese_stops(q: Spark, t: str) -> str:
    """Commas and stops after Japanese characters become full-width."""
    near = r"\x{3041}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}"
    return q.replace(q.replace(t, f"([{near}]) ?,", "\\1，"), f"([{near}]) ?\\.", "\\1．")


def drop_cjk_spaces(q: Spark, t: str) -> str:
    """Spaces between Japanese characters go (twice, for neighbours overlap)."""
    once = q.replace(t, f"([{CJK}]) +([{CJK}])", "\\1\\2")
    return q.replace(once, f"([{CJK}]) +([{CJK}])", "\\1\\2")


def letter_spaced(q: Spark, t: str) -> str:
    """Four or more tokens, four fifths of them single characters."""
    n = q.count(t, f"[^{WS}]+")
    single = q.count(t, f"(?<![^{WS}])[^{WS}](?![^{WS}])") if q.name == "spark" else q.size(q.where(words(q, t), lambda x: f"length({x}) = 1"))
    return f"({n} >= 4 AND {ratio(q, single, n, 8, 10)})"


def collapse_letterspacing(q: Spark, t: str) -> str:
    """A line that is all spaced capitals, two thirds of them single, becomes a word."""
    line = q.has(t, r"^\p{Lu}{1,2}( \p{Lu}{1,2}){3,}$")
    tokens = q.all(t, r"\p{Lu}+")
    enough = ratio(q, q.size(q.where(tokens, lambda x: f"length({x}) = 1")), q.size(tokens), 2, 3)
    return f"(CASE WHEN {line} AND {enough} THEN {q.replace(t, ' ')} ELSE {t} END)"


def dehyphenate(q: Spark, t: str) -> str:
    """Words hyphenated at line ends are joined."""
    return q.replace(t, r"-[ \t\r]*\n\s*([a-z])", "\\1")


def web_uri(q: Spark, t: str) -> str:
    """A file address whose host is a web host is a web address."""
    rest = q.replace(t, "^file:/*")
    web = q.has(rest, r"^(www\.|[^/?#:]*\.[A-Za-z]{2,}([/?#]|$))")
    return f"(CASE WHEN {q.has(t, '^file:')} AND length({rest}) > 0 AND {web} THEN concat('https://', {rest}) ELSE {t} END)"


def url_continues(q: Spark, t: str) -> str:
    """The last token is an address cut where it goes on."""
    last = q.last_word(t)
    url = q.has(last, r"://|^www\.|^doi:|^doi\.org|^10\..*/")
    if q.name == "spark":  # few lines end so: that is looked at first
        return f"({q.has(f'substr({right_trimmed(q, t)}, -1)', '[/._=?&#-]')} AND {url})"
    return f"({url} AND {q.has(last, '[/._=?&#-]$')})"


def unspace_address(q: Spark, t: str) -> str:
    """Spaces next to the punctuation of a web address go, in the words that follow its start."""
    head, tail = q.first(t, r"^(.*?)(?:https?|www\.|doi\.org).*$", 1), q.first(t, r"((?:https?|www\.|doi\.org).*)$", 1)
    address = q.first(tail, r"^(?:[^ ]* *[./:_=?&#-] *)*[^ ]*")
    after = f"substr({tail}, length({address}) + 1)"
    return f"(CASE WHEN {tail} = '' THEN {t} ELSE concat({head}, {q.replace(address, ' ')}, {after}) END)"


def esc_html(q: Spark, t: str) -> str:
    return f"replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def esc_md(q: Spark, t: str) -> str:
    """Markdown's own characters; brackets only where they could make a link, "<" only where a tag could start."""
    slash = "\\\\"  # one, to both engines' replacement syntax
    once = q.replace(t, r"([\\*_\x60])", slash + "\\1")
    tags = q.replace(once, r"<([A-Za-z/!?])", slash + "<\\1")
    return f"(CASE WHEN contains({t}, '](') THEN {q.replace(tags, r'([\[\]])', slash + chr(92) + '1')} ELSE {tags} END)"


def needs_guard(q: Spark, t: str) -> str:
    """A Markdown reader would take the line for a heading, an item, a quotation, a table row or a rule."""
    return q.has(t, rf"^[{WS}]*([#>|]|[-+*=~]([{WS}]|$)|(-+|\++|\*+|=+|~+)[{WS}]*$|[0-9]{{1,9}}[.)][{WS}])")


def guard_line(q: Spark, t: str) -> str:
    trimmed_ = left_trimmed(q, t)
    number = q.first(trimmed_, "^[0-9]+")
    slash = "'\\\\'" if q.name == "spark" else "'\\'"
    return f"(CASE WHEN NOT {needs_guard(q, t)} THEN {t} WHEN {number} <> '' THEN concat({number}, {slash}, substr({trimmed_}, length({number}) + 1)) ELSE concat({slash}, {trimmed_}) END)"


def list_number(q: Spark, t: str) -> str:
    """The number that an item opens with, or null."""
    found = q.first(t, rf"^[{WS}]*(?:\(([0-9]{{1,3}})\)|([0-9]{{1,3}})[.)])[{WS}]", 1)
    other = q.first(t, rf"^[{WS}]*([0-9]{{1,3}})[.)][{WS}]", 1)
    return f"(CASE WHEN {found} <> '' THEN {q.big(found)} WHEN {other} <> '' THEN {q.big(other)} END)"


def strip_marker(q: Spark, t: str) -> str:
    """The item without its bullet."""
    return q.replace(t, f"^[{WS}]*[•·▪●◦‣–・]?[{WS}]*")


def image_link(q: Spark, t: str) -> str:
    """Characters that end or break a link's destination, percent-encoded."""
    codes = ["%", " ", "(", ")", "[", "]", "<", ">", "#", '"', "`", "?"]
    out = t
    for c in codes:
        out = f"replace({out}, {_plain(q, c)}, '%{ord(c):02X}')"
    return out


def alt_text(q: Spark, t: str) -> str:
    """At most 100 characters; longer ones are cut before the word that would pass 97 and end in an ellipsis."""
    flat = trimmed(q, q.replace(q.replace(t, r"[\[\]\x22\n]", " "), f"[{WS}]+", " "))
    cut = q.first(flat, r"^(.{0,96})[ ]", 1)
    return f"(CASE WHEN length({flat}) <= 100 THEN {flat} ELSE concat({cut}, '…') END)"


# 2.3 predicates


def is_cjk(q: Spark, t: str) -> str:
    return q.has(t, f"[{CJK}]")


def is_math_char(q: Spark, t: str) -> str:
    return q.has(t, f"[{MATH_CHARS}]")


def is_math_font(q: Spark, t: str) -> str:
    return q.has(f"lower({t})", alternatives(MATH_FONTS))


def font_bold(q: Spark, t: str) -> str:
    return q.has(f"lower({t})", r"bold|heavy|black|\.b$|\.bi$|-bd$|,bd$")


def font_italic(q: Spark, t: str) -> str:
    return q.has(f"lower({t})", r"italic|oblique|\.i$|\.bi$|-it$")


def cover_sheet(q: Spark, t: str) -> str:
    """A publisher's cover sheet: two strong phrases, or one and two weak ones, in at most 6000 characters."""
    low = f"lower({t})"
    strong, weak = contains_count(q, low, COVER_STRONG), contains_count(q, low, COVER_WEAK)
    return f"(length({t}) <= 6000 AND ({strong} >= 2 OR ({strong} >= 1 AND {weak} >= 2)))"


def prose_like(q: Spark, t: str) -> str:
    """Japanese with its punctuation, or four words and more of which an eighth are function words."""
    bare = q.where(q.each(words(q, t), lambda x: f"lower({q.replace(x, r'^[^\p{L}]+|[^\p{L}]+$')})"), lambda x: f"{x} <> ''")
    japanese = f"{q.count(t, f'[{CJK}]')} >= 10"
    if q.name == "spark":  # words with a letter, and those whose letters, marks aside, are a function word's
        n = q.count(t, rf"(?<![^{WS}])[^\p{{L}}{WS}]*+\p{{L}}")
        known = q.count(t, rf"(?<![^{WS}])[^\p{{L}}{WS}]*+(?i:{'|'.join(FUNCTION_WORDS)})[^\p{{L}}{WS}]*+(?![^{WS}])")
        japanese = f"octet_length({t}) >= length({t}) + 20 AND {japanese}"  # such a letter takes three bytes
        return f"(CASE WHEN {japanese} THEN {q.has(t, '[。、，．]')} ELSE ({n} >= 4 AND {known} * 8 >= {n}) END)"
    english = q.let(bare, lambda b: f"({q.size(b)} >= 4 AND {q.size(q.where(b, lambda x: one_of(q, x, FUNCTION_WORDS)))} * 8 >= {q.size(b)})")
    return f"(CASE WHEN {japanese} THEN {q.has(t, '[。、，．]')} ELSE {english} END)"


def caption_kind(q: Spark, t: str) -> str:
    """'table', 'figure' or null: the label and its number, not a sentence that goes on with a verb or a particle."""
    s = left_trimmed(q, t)
    verb = f"({q.has(s, rf'^[^{WS}]+[{WS}]+([0-9][^{WS}]*[^{WS}.:|][{WS}]+|[0-9][{WS}]+)?[\p{{Ll}}][^{WS}]*')} AND {q.size(q.all(q.first(s, rf'^[^{WS}]+[{WS}]+(?:[0-9][^{WS}]*[{WS}]+)?(\p{{Ll}}[^{WS}]*)', 1), r'\p{L}'))} >= 3 AND NOT {q.has(s, '^[図表]')})"
    particle = q.has(s, r"^[A-Za-z. 図表]*[0-9０-９()（）.\-–, a-z]*[\x{3040}-\x{309F}]")
    number = "[0-9０-９一二三四五六七八九十〇ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]"
    table = q.has(s, rf"^(?i:table)[{WS}]*[0-9IVXS]|^表[{WS}]*{number}|^第{number}+表")
    figure = q.has(s, rf"^(?i:fig\.|figure|plate)[{WS}]*[0-9IVXS]|^図[{WS}]*{number}|^第{number}+図")
    return f"(CASE WHEN NOT ({table} OR {figure}) THEN NULL WHEN {verb} OR {particle} THEN NULL WHEN {table} THEN 'table' ELSE 'figure' END)"  # most lines fail the first, cheap test


def numbered_heading_depth(q: Spark, t: str) -> str:
    """The depth of a section number before a title in Latin letters, or null."""
    number = q.first(t, rf"^[{WS}]*((?:[0-9]+\.)*[0-9]+\.?)[{WS}]+(?:\|[{WS}]*)?\p{{L}}", 1)
    return f"(CASE WHEN {number} <> '' THEN {q.count(number, '[0-9]+')} END)"


def heading_number(q: Spark, t: str) -> str:
    """Depth by decimal numbers, Roman numerals with a stop, or a number with a bracket."""
    roman_ = q.has(t, rf"^[{WS}]*[IVX]+\.[{WS}]+\p{{L}}|^[{WS}]*[IVX]+[.．][{WS}]*[{CJK}]")
    bracket = q.has(t, rf"^[{WS}]*[0-9０-９]{{1,2}}[)）][{WS}]*\p{{L}}")
    wide = q.has(t, rf"^[{WS}]*[0-9０-９]{{1,2}}．[{WS}]*\p{{L}}")
    return f"(CASE WHEN {numbered_heading_depth(q, t)} IS NOT NULL THEN {numbered_heading_depth(q, t)} WHEN {roman_} OR {wide} THEN 1 WHEN {bracket} THEN 2 END)"


def japanese_title(q: Spark, t: str) -> str:
    return q.has(t, rf"^[{CJK}]|^[A-Z].{{0,2}}[{CJK}]|^[0-9]{{4}}[{WS}]*年")


def _heading_key(q: Spark, t: str) -> str:
    return f"lower({unspaced(q, q.replace(trimmed(q, t), '[:.]+$'))})"


def _heading_of(q: Spark, t: str, names: list[str]) -> str:
    """Whether the key is one of the names; a line with more characters than any of them (Spark is asked that first) is none."""
    found = one_of(q, _heading_key(q, t), names)
    if q.name != "spark":
        return found
    longer = q.has(t, rf"^(?:[{WS}:.]*+[^{WS}:.]){{{max(map(len, names)) + 1}}}")
    return f"(NOT {longer} AND {found})"


def is_front_heading(q: Spark, t: str) -> str:
    return _heading_of(q, t, FRONT_HEADINGS)


def is_closing_heading(q: Spark, t: str) -> str:
    return _heading_of(q, t, CLOSING_HEADINGS)


def _heading_words(q: Spark, t: str) -> str:
    return q.replace(f"lower({q.replace(trimmed(q, t), '[:.]+$')})", "^[0-9. ]+")


def is_references_heading(q: Spark, t: str) -> str:
    return one_of(q, _heading_words(q, t), REFERENCE_HEADINGS)


def is_refs_heading(q: Spark, t: str) -> str:
    """More names, after an arabic or Roman section number; Japanese ones end in the word for literature."""
    bare = q.replace(q.replace(trimmed(q, t), "[:.。]+$"), rf"^([0-9]+|[IVX]+)\.?[{WS}]+")
    compact = unspaced(q, bare)
    japanese = f"(length({compact}) <= 10 AND {q.has(compact, '(文献|文献一覧|文献リスト|文献目録)$')} AND NOT {q.has(compact, r'[\x{3040}-\x{309F}]')})"
    return f"({japanese} OR {one_of(q, f'lower({trimmed(q, bare)})', REFERENCE_SECTIONS)})"


def is_references(q: Spark, t: str) -> str:
    return one_of(q, f"lower({q.replace(trimmed(q, t), rf'^[0-9.{WS}]+')})", TRANSLATION_REFERENCES)


def section_word(q: Spark, t: str) -> str:
    return q.has(q.replace(f"lower({q.replace(trimmed(q, t), '[:.]+$')})", f"^[0-9.{WS}]+"), "^" + alternatives(SECTION_WORDS))


def caps_heading(q: Spark, t: str) -> str:
    s = trimmed(q, t)
    letters, upper = q.count(s, r"\p{L}"), q.count(s, r"\p{Lu}")
    return f"({letters} >= 6 AND length({s}) <= 100 AND {upper} * 10 >= {letters} * 9 AND NOT {q.has(s, '[,;.]$')} AND {q.count(s, '[0-9]')} <= 4)"


def is_byline(q: Spark, t: str) -> str:
    """Names of one to six capitalised words, at least two of them, set apart by commas, marks or "and"."""
    marks, joints = "|,;·•&*＊∗⁎†‡§¶#()0-9", " and | und | et "
    if q.name == "spark":
        return _is_byline_counted(q, t, marks, joints)
    groups = q.where(q.each(q.all(q.replace(t, joints, "|"), f"[^{marks}]+"), lambda x: trimmed(q, x)), lambda x: q.has(x, r"\p{L}"))
    name = rf"^(?:(?:\p{{Lu}}[\p{{L}}.\x27’-]*|de|da|di|del|della|van|von|der|den|la|le|du|dos|das|y|e|bin|ter|\p{{Ll}})[{WS}]*){{1,6}}$"
    few = f"{q.count(t, rf'[^{WS}]*\p{{L}}[^{WS}]*')} BETWEEN 2 AND 4"
    named = q.let(groups, lambda g: q.let(q.size(q.where(g, lambda x: q.has(x, name))), lambda good: f"(({q.size(g)} = 1 AND {good} = 1 AND {few}) OR ({q.size(g)} >= 2 AND {good} * 10 >= {q.size(g)} * 9))", "good"))
    return f"(CASE WHEN length({t}) > 600 OR NOT {q.has(t, r'\p{Lu}')} OR {is_front_heading(q, t)} THEN false ELSE {named} END)"


def _is_byline_counted(q: Spark, t: str, marks: str, joints: str) -> str:
    """The same without lists: groups and names are counted in place.

    With less than ten groups every one has to be a name. So a line that is cut less than nine times goes at its first group that is none.
    Classes of characters below 256, named one by one, are looked up in a table; other classes are chains of calls, which slow each other down in threads of one JVM.
    """
    joint = " (?:and|und|et) "
    low, high = "".join(x for x in marks.replace("0-9", "0123456789") if x < "\u0100"), "".join(x for x in marks if x > "\u00ff")
    others = "".join(f"\\x{c:02x}" for c in range(256) if chr(c) not in low + " ")  # below 256, neither mark nor space
    # a capitalised word ends where its letters do, so it never gives any back
    names = rf"(?:(?:\p{{Lu}}[\p{{L}}.\x27’-]*+|d(?:ella|e[lrn]|[oa]s|[aeiu])|v[ao]n|l[ae]|bin|ter|\p{{Ll}})(?:(?!{joint})[{WS}])*+){{1,6}}"
    between = rf"(?:[^\p{{L}} ]++|{joint}| )*+"
    all_names = rf"^{between}(?:(?>{names}(?:[{marks}]|{joint}|$)){between})++$"
    nine_cuts = rf"^(?:(?:(?>[{others}]+)| (?!{joint[1:]}))*+(?:[^{others} ]| (?:and|und|et)(?= ))){{9}}"  # every other character counts as a mark, which keeps some lines too many
    cut = q.replace(t, f"{joint}|[{high}]", "|")
    n, good = q.count(cut, rf"\p{{L}}[^{low}]*+"), q.count(cut, rf"(?<![^{low}])[{WS}]*+{names}(?![^{low}])")
    few = f"{q.count(t, rf'\p{{L}}[^{WS}]*+')} BETWEEN 2 AND 4"
    named = f"({good} * 10 >= {n} * 9 AND ({few} OR {n} >= 2))"
    may = f"({q.has(t, all_names)} OR {q.has(t, nine_cuts)})"
    return f"(CASE WHEN length({t}) > 600 OR NOT {q.has(t, r'\p{Lu}')} OR NOT {may} OR {is_front_heading(q, t)} THEN false ELSE {named} END)"


def is_strong_byline(q: Spark, t: str) -> str:
    marks = f"({q.has(t, rf'(^|[{WS}])\p{{Lu}}\.(-?\p{{Lu}}\.?){{0,2}},?([{WS}]|$)')} OR {q.count(t, '[,·;]')} >= 2 OR {q.has(t, '[*＊∗†‡0-9]')})"
    return f"({is_byline(q, t)} AND {marks})"


def note_opening(q: Spark, t: str) -> str:
    s = left_trimmed(q, t)
    return f"({q.has(f'lower({s})', '^' + alternatives(NOTE_STARTS))} OR {q.has(s, '^[*†‡©∗]')})"


def dates_line(q: Spark, t: str) -> str:
    low = f"lower({q.replace(trimmed(q, t), '^[(（]+')})"
    return f"(length({t}) <= 120 AND {q.has(t, '[0-9]')} AND ({q.has(t, '受付|受理')} OR {q.has(low, '^(received|manuscript received)')}))"


def find_year(q: Spark, t: str) -> str:
    """The first year from 1800 to 2030 that isn't part of a longer number, or null."""
    found = q.first(t, r"(?:^|[^0-9])(1[89][0-9][0-9]|20[0-2][0-9]|2030)(?:$|[^0-9\p{L}]|\p{L}(?:$|[^\p{L}]))", 1)
    return f"(CASE WHEN {found} <> '' THEN {q.big(found)} END)"


def has_year(q: Spark, t: str) -> str:
    return f"({find_year(q, t)} IS NOT NULL OR {q.has(f'lower({t})', r'in press|submitted|forthcoming|n\.d\.')})"


def dated_note(q: Spark, t: str) -> str:
    low = f"lower({q.replace(trimmed(q, t), r'^[(\[]+')})"
    return f"({q.has(low, '^' + alternatives(DATED_STARTS))} AND {find_year(q, low)} IS NOT NULL AND length({low}) < 120)"


def is_boilerplate(q: Spark, t: str) -> str:
    low = f"lower({trimmed(q, t)})"
    licence = f"(contains({low}, 'creative commons') AND contains({low}, 'licen') AND length({low}) < 400)"
    return f"(length({low}) <= 500 AND ({q.has(low, '^' + alternatives(BOILERPLATE_STARTS))} OR contains({low}, 'all rights reserved') OR {licence}))"


def is_kicker(q: Spark, t: str) -> str:
    return one_of(q, q.replace(f"lower({q.replace(trimmed(q, t), '[:：]+$')})", f"[{WS}]+", " "), KICKERS)


def repetitive(q: Spark, t: str) -> str:
    w, c = words(q, t), q.all(t, f"[^{WS}]")
    if q.name == "spark":
        few = q.let(c, lambda x: f"({q.size(x)} BETWEEN 2 AND 6 AND {q.size(q.distinct(x))} * 2 <= {q.size(x)})", "each")
        return q.let(w, lambda x: f"(CASE WHEN {q.size(x)} >= 6 THEN {q.size(q.distinct(x))} * 10 < {q.size(x)} * 6 ELSE {few} END)")
    return f"(CASE WHEN {q.size(w)} >= 6 THEN {q.size(q.distinct(w))} * 10 < {q.size(w)} * 6 ELSE {q.size(c)} BETWEEN 2 AND 6 AND {q.size(q.distinct(c))} * 2 <= {q.size(c)} END)"


def panel_labels(q: Spark, t: str) -> str:
    if q.name == "spark":  # one pass that ends at the first word that is no label
        mark = r"[()（）\x27’.,]*+"
        return q.has(t, rf"^[{WS}]*+(?:{mark}[A-Za-z0-9]{mark}(?:[A-Za-z0-9]{mark})?+(?:[{WS}]++|\z))++\z")
    bare = q.each(words(q, t), lambda x: q.replace(x, r"[()（）\x27’.,]+"))
    return f"({q.size(bare)} > 0 AND {q.size(q.where(bare, lambda x: q.has(x, '^[A-Za-z0-9]{1,2}$')))} = {q.size(bare)})"


def item_number(q: Spark, t: str) -> str:
    """The number of a list's item: up to three digits, a stop or a bracket, and words."""
    found = q.first(t, rf"^[{WS}]*([0-9]{{1,3}})[.)](?:[{WS}]|\p{{Lu}}|[{CJK}])", 1)
    return f"(CASE WHEN {found} <> '' AND {q.count(t, r'\p{L}')} >= 3 THEN {q.big(found)} END)"


def is_list_marker(q: Spark, t: str) -> str:
    return q.has(t, rf"^[{WS}]*([•·▪●◦‣–・]|\([A-Za-z0-9][^)]{{0,2}}\))")


def has_equation_number(q: Spark, t: str) -> str:
    return q.has(t, rf"\([A-Za-z.]{{0,4}}[0-9][A-Za-z0-9.]{{0,4}}\)[{WS}]*$") + f" AND length({q.first(t, rf'\(([A-Za-z0-9.]*)\)[{WS}]*$', 1)}) <= 5"


def ends_sentence(q: Spark, t: str) -> str:
    return q.has(t, rf"^[{WS}]*$|[.!?:。．！？」』）)][{WS}]*$")


def more_opened(q: Spark, t: str) -> str:
    """More brackets are opened than closed."""
    more = f"{q.count(t, r'\(')} > {q.count(t, r'\)')}"
    return f"(contains({t}, '(') AND {more})" if q.name == "spark" else more


def open_end(q: Spark, t: str) -> str:
    """The text cannot end here: a comma, an open bracket, or a word that wants another."""
    last = q.last_word(t, some=False)
    end = q.has(f"substr({right_trimmed(q, t)}, -1)", r"[,;(\[–—]") if q.name == "spark" else q.has(t, rf"[,;(\[–—][{WS}]*$")
    return f"({end} OR {more_opened(q, t)} OR ({one_of(q, last, OPEN_WORDS)} AND {q.count(t, f'[^{WS}]+')} >= 4))"


def starts_low(q: Spark, t: str) -> str:
    """A text that carries on a sentence: it opens in lower case or with a comma or semicolon."""
    return q.has(t, r"^[\p{Ll},;]")


def starts_weakly(q: Spark, t: str) -> str:
    return q.has(t, rf"^[0-9(\[、{CJK}]") + f" AND NOT {q.has(t, r'^[\x{3000} ]')}"


def marker(q: Spark, t: str) -> str:
    """The number of a reference's marker ("[12]", "12.", "12)", "(12)"), or null."""
    square, round_ = q.first(t, rf"^[{WS}]*\[([0-9]{{1,3}})\](?:$|[^0-9])", 1), q.first(t, rf"^[{WS}]*\(([0-9]{{1,3}})\)(?:$|[^0-9])", 1)
    plain_ = q.first(t, rf"^[{WS}]*([0-9]{{1,3}})[.)](?:$|[{WS}]|\p{{Lu}}|[{CJK}])", 1)
    return f"(CASE WHEN {square} <> '' THEN {q.big(square)} WHEN {round_} <> '' THEN {q.big(round_)} WHEN {plain_} <> '' THEN {q.big(plain_)} END)"


def marker_only(q: Spark, t: str) -> str:
    return f"({marker(q, t)} IS NOT NULL AND {q.count(t, r'\p{L}')} = 0)"


SURNAME = r"\p{Lu}[\p{L}\x27’-]*\p{L}"
PARTICLE = "(?:de|da|di|del|della|van|von|der|den|la|le|du|dos|das|ter|ten|al|el|bin|st)"
INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.?){0,2}"


def surname(q: Spark, t: str) -> str:
    return q.has(t, f"^{SURNAME}[,;]*$")


def initials(q: Spark, t: str) -> str:
    return q.has(t, f"^{INITIALS},*$")


def bare_initials(q: Spark, t: str) -> str:
    return q.has(t, r"^[.-]*[A-Z](?:[.-]*[A-Z]){0,2}[.-]*,*$")


def author_start(q: Spark, t: str) -> str:
    """"Surname, I." with up to three words in the surname, or "Surname IJ," before a comma, a year or "and"."""
    comma = rf"^[{WS}]*(?:(?:{SURNAME}|{PARTICLE})[{WS}]+){{0,2}}[\p{{L}}\x27’-]*\p{{L}}[\p{{L}}\x27’-]*\p{{L}},[{WS}]+{INITIALS},*(?:[{WS}]|$)"
    bare = rf"^[{WS}]*(?:{PARTICLE}[{WS}]+)*{SURNAME}(?:[{WS}]+{SURNAME})?[{WS}]+[A-Z](?:[.-]*[A-Z]){{0,2}}[.-]*(?:,|[{WS}]+(?:\(|and[{WS}]|&[{WS}]|et[{WS}]))"
    label = q.has(t, rf"^[{WS}]*(?:Figure|Fig|Table|Section|Appendix|Plate|Panel|Part|Method|Type|Group|Unit|Region|Site|Sample|Model|Case|Step|Phase|Zone|Line|Box)[{WS}]")
    return f"({q.has(t, comma)} OR ({q.has(t, bare)} AND NOT {label}))"


def cjk_year(q: Spark, t: str) -> str:
    head = f"substr({t}, 1, 40)"
    return f"({q.has(t, rf'^[{CJK}]')} AND NOT {q.has(t, r'^[\x{3000}-\x{303F}\x{FF00}-\x{FF0F}]')} AND {find_year(q, head)} IS NOT NULL)"


def cjk_bib(q: Spark, t: str) -> str:
    return q.has(t, rf"^[{CJK}][{CJK}{WS},.&・ー]{{0,39}}(?:1[89][0-9][0-9]|20[0-2][0-9]|2030)(?:$|[^0-9])") + f" AND NOT {q.has(t, r'^[^0-9]*[()（）]')} AND {cjk_year(q, t)}"


def initials_first(q: Spark, t: str) -> str:
    return q.has(t, rf"^[{WS}]*(?:{INITIALS}[{WS}]+){{1,3}}\p{{Lu}}[\p{{L}}\x27’-]*\p{{Ll}}[\p{{L}}\x27’-]*\p{{Ll}}[,;]?(?:$|[{WS}]+(?:and|&|et)[{WS}]|[{WS}]+\p{{Lu}}|[{WS}]+[^{WS}]+,)")


def full_name(q: Spark, t: str) -> str:
    return q.has(t, rf"^[{WS}]*{SURNAME},[{WS}]+\p{{Lu}}\p{{L}}{{2,}}[,;]?[{WS}]") + f" AND NOT {q.has(t, rf'^[{WS}]*[^{WS}]+[{WS}]+(?:The|In|However|For|And|But|This|That|These|See|Thus)[{WS}]')} AND {has_year(q, t)}"


def lead(q: Spark, t: str) -> str:
    """'strong', 'weak' or 'no': how a text starts an entry of a reference list."""
    s = q.replace(t, rf"^[{WS}]*(?:\[[0-9]{{1,3}}\]|\([0-9]{{1,3}}\)|[0-9]{{1,3}}[.)])[{WS}]*")
    return f"(CASE WHEN {author_start(q, s)} OR ({cjk_bib(q, s)}) THEN 'strong' WHEN {initials_first(q, s)} OR ({full_name(q, s)}) OR {cjk_year(q, s)} THEN 'weak' ELSE 'no' END)"


def entry_end(q: Spark, t: str) -> str:
    """How firmly a text ends an entry: 2, 1 or 0."""
    s = right_trimmed(q, t)
    last = q.last_word(s, some=False, spaced=False)
    tail = f"substr({s}, -9)" if q.name == "spark" else s  # as much as the patterns below ask for
    url = q.has(last, r"://|doi\.org|^(?i:doi:)|^10\..*/|^www\.")
    range_ = q.has(last, r"[0-9A-Za-z][-–—−][0-9]+[.)]*\.$")
    year = q.has(last, r"(?:^|[^0-9])(?:1[89][0-9][0-9]|20[0-2][0-9]|2030)[a-z]?[.)]*\.$")
    return f"(CASE WHEN {s} = '' OR {url} OR {range_} OR {year} OR {q.has(tail, r'in press\.$|[。．]$')} THEN 2 WHEN {q.has(tail, '[.0-9)]$')} THEN 1 ELSE 0 END)"


def roman(q: Spark, t: str) -> str:
    """A Roman numeral in its usual spelling, of at most six letters; "I" alone is a word."""
    canonical = r"^(?:C{0,3}(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))$"
    low = r"^(?:c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))$"
    return f"(length({t}) BETWEEN 1 AND 6 AND (({q.has(t, canonical)} AND length({t}) >= 2) OR {q.has(t, low)}))"


PAGE = "[0-9]{1,4}[a-z]?"


def page_token(q: Spark, t: str) -> str:
    s = q.replace(t, "[,;.]+$")
    return f"({q.has(s, rf'^{PAGE}([–—−-]{PAGE})?$')} OR {roman(q, s)})"


def trailing_pages(q: Spark, t: str) -> str:
    """The page references that a row of contents or an index ends in, or null."""
    found = q.first(t, rf"(?:^|[{WS}])((?:{PAGE}(?:[–—−-]{PAGE})?[,;][{WS}]+)*{PAGE}(?:[–—−-]{PAGE})?)[,;{WS}]*$", 1)
    table = q.has(t, rf"(?:^|[{WS}]){PAGE}[{WS}]+{PAGE}[,;{WS}]*$")
    return f"(CASE WHEN {found} <> '' AND NOT {table} THEN {found} END)"


def first_page(q: Spark, t: str) -> str:
    return q.big(q.first(f"coalesce({trailing_pages(q, t)}, '')", "^[0-9]+"))


def heading_word(q: Spark, t: str) -> str:
    low = q.replace(f"lower({q.replace(trimmed(q, t), '[:.]+$')})", f"[{WS}]+", " ")
    return f"({one_of(q, low, CONTENTS_HEADINGS)} OR {q.has(low, '^(index of |list of )')})"


def looks_numeric(q: Spark, t: str) -> str:
    return q.has(q.replace(t, r"[, %±+−\-()*~<>]+"), "^[0-9.eE×]+$")


def garbled(q: Spark, t: str) -> str:
    """A symbol, a capital or digits inside a word, or a digit for its first letter."""
    letters = q.count(t, "[A-Za-z]")
    inside = f"({q.has(t, rf'[a-z][^A-Za-z0-9\x27’.{WS}][a-z]')} OR ({q.has(t, '^[a-z]')} AND {q.has(t, '[a-z][A-Z]')}) OR ({q.has(t, '^[A-Za-z]')} AND {q.has(t, '[A-Za-z][0-9]+[a-z]')}))"
    found = f"({q.has(t, '^[0-9][a-z]{3,}$')} OR ({letters} >= 4 AND {inside}))"
    return f"(NOT {q.has(t, '^[A-Za-z]?[a-z]*+[.,]?$')} AND {found})" if q.name == "spark" else found  # most words are plain


def latin_text(q: Spark, t: str) -> str:
    s = unspaced(q, t)
    ascii_ = q.count(s, r"[\x{21}-\x{7E}]")
    return f"({q.count(s, '[A-Za-z]')} >= 4 AND {ascii_} * 10 >= length({s}) * 7)"


def mostly_symbols(q: Spark, t: str) -> str:
    """Fewer than a third of the characters belong to words of two letters or more."""
    return f"(length({q.replace(t, r'[^\p{L}]+', ' ')}) >= 0 AND coalesce(length({q.join(q.all(t, r'\p{L}{2,}'), '')}), 0) * 3 < length({unspaced(q, t)}))"


def looks_like_reference(q: Spark, t: str) -> str:
    """A year in brackets near the start and a volume with pages."""
    return f"({q.has(f'substr({t}, 1, 95)', r'\([0-9]{4}[)a-z]')} AND {q.has(t, r': *[0-9]+[–—-][0-9]')})"


def is_japanese(q: Spark, t: str) -> str:
    letters = q.count(t, r"\p{L}")
    return f"({letters} > 0 AND {q.count(t, r'[\x{3041}-\x{3096}\x{30A1}-\x{30FA}]')} * 10 >= {letters})"


def translatable(q: Spark, t: str) -> str:
    return f"({q.count(t, r'\p{L}')} >= 2 AND NOT {is_japanese(q, t)} AND NOT {mostly_symbols(q, t)} AND NOT {looks_like_reference(q, t)})"


def num_ratio_high(q: Spark, t: str) -> str:
    """At least half of the characters are digits."""
    return f"(length({t}) > 0 AND {q.count(t, '[0-9]')} * 2 >= length({t}))"


def tripled_word(q: Spark, t: str) -> str:
    """A word of two letters and more three times running."""
    return q.let(words(q, t), lambda w: f"({q.size(q.where(q.steps(f'{q.size(w)} - 2'), lambda x: self_same(q, w, x)))} > 0)")


def self_same(q: Spark, w: str, i: str) -> str:
    at = (lambda k: f"get({w}, {i} + {k - 1})") if q.name == "spark" else (lambda k: f"({w})[{i} + {k}]")
    return f"({at(0)} = {at(1)} AND {at(1)} = {at(2)} AND {q.count(at(0), r'\p{L}')} >= 2)"


# 2.4 normalization


def digits_key(q: Spark, t: str) -> str:
    """Without white space, digits as "#": repeated heads with page numbers become equal."""
    return q.replace(unspaced(q, t), "[0-9]", "#")


def compact_text(q: Spark, t: str) -> str:
    """Letters and numbers but ASCII digits, in lower case."""
    return f"lower({q.replace(t, r'[^\p{L}\p{N}]+|[0-9]+')})"


def bigrams(q: Spark, t: str) -> str:
    """The set of neighbouring pairs of characters, white space left out."""
    return q.let(unspaced(q, t), lambda s: q.distinct(q.each(q.steps(f"length({s}) - 1"), lambda x: f"substr({s}, cast({x} AS int), 2)")))


def quality_words(q: Spark, t: str) -> str:
    """ASCII words of two characters and more, hyphens and slashes apart, surrounding marks and the genitive off."""
    parts = q.all(t, rf"[^{WS}–/-]+")
    if q.name == "spark":  # the same without patterns for each word
        bare = q.each(parts, lambda x: f"trim(BOTH '{TRIMMED_MARKS}' FROM {x})")
        bare = q.each(bare, lambda x: f"(CASE WHEN endswith({x}, '\\'s') OR endswith({x}, '’s') THEN left({x}, length({x}) - 2) ELSE {x} END)")
        return q.where(bare, lambda x: f"octet_length({x}) >= 2 AND octet_length({x}) = length({x})")
    bare = q.each(parts, lambda x: q.replace(q.replace(x, f"^[{WORD_MARKS}]+|[{WORD_MARKS}]+$"), "[\\x27’]s$"))
    return q.where(bare, lambda x: f"length({x}) >= 2 AND {q.has(x, r'^[\x{00}-\x{7F}]+$')}")


def audit_tokens(q: Spark, t: str) -> str:
    """Runs of letters and digits with inner hyphens and apostrophes joined, of two letters and more; Japanese characters one by one."""
    joined = q.replace(f"lower({t})", r"([\p{L}\p{N}])[-\x{2010}\x{2011}\x{AD}\x27’]([\p{L}\p{N}])", "\\1\\2")
    return q.where(q.all(joined, r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]|[\p{L}\p{N}]+"), lambda x: f"{q.has(x, f'^[{CJK}]$')} OR {q.count(x, r'\p{L}')} >= 2")


def tokens(q: Spark, t: str) -> str:
    """Lower-case runs of letters and digits."""
    return q.all(f"lower({t})", r"[\p{L}\p{N}]+")


# 2.3, more predicates


def has_kanji(q: Spark, t: str) -> str:
    return q.has(t, r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]")


def has_hiragana(q: Spark, t: str) -> str:
    return q.has(t, r"[\x{3041}-\x{3096}]")


def has_katakana(q: Spark, t: str) -> str:
    return q.has(t, r"[\x{30A1}-\x{30FA}\x{30FC}]")


def wants_more(q: Spark, t: str) -> str:
    """A row of contents or of an index that goes on in the next."""
    s = right_trimmed(q, t)
    tail = f"substr({s}, -1)" if q.name == "spark" else s
    return f"({q.has(tail, r'[,;(–—/-]$')} OR {more_opened(q, s)} OR {one_of(q, f'lower({q.last_word(s, some=False, spaced=False)})', WANTING_WORDS)})"


def opens_entry(q: Spark, t: str) -> str:
    """The first letter is no small one, so that an entry may start here; styles aside."""
    return f"({q.has(t, f'[^{WS}]')} AND NOT {q.has(t, rf'^[{WS}]*\p{{Ll}}')})"


def math_permille(q: Spark, t: str) -> str:
    """Mathematical characters of a thousand that are not white space; bullets don't count."""
    bare = unspaced(q, t)
    return q.let(bare, lambda b: f"(CASE WHEN length({b}) > 0 THEN cast(floor({q.count(b, f'[{MATH_CHARS}]')} * 1000 / length({b})) AS bigint) END)")


def is_equation_line(q: Spark, t: str) -> str:
    """An equation with its number, on a line of its own."""
    s = trimmed(q, t)
    before = trimmed(q, q.first(s, r"^(.*)\([^(]*$", 1))
    mathy = f"(contains({s}, '=') OR {q.count(s, f'[{MATH_CHARS}]')} * 5 >= length({s}))"
    return f"({has_equation_number(q, s)} AND length({before}) >= 3 AND length({s}) < 90 AND {mathy})"


def is_mathish(q: Spark, t: str) -> str:
    """A piece of a displayed formula: a fifth mathematical, or a few characters one of which is, or a short text with an equation number."""
    s = trimmed(q, t)
    tiny = f"(length({s}) <= 4 AND {q.has(s, f'[{MATH_CHARS}()]')})"
    share = f"({q.count(unspaced(q, t), f'[{MATH_CHARS}]')} * 5 >= length({unspaced(q, t)}) AND length({unspaced(q, t)}) > 0)"
    return f"({share} OR {tiny} OR ({has_equation_number(q, t)} AND length({t}) < 80))"


def title_like(q: Spark, t: str) -> str:
    """What an emphasised run must look like to be a heading that a paragraph swallowed."""
    s = trimmed(q, t)
    return f"(length({s}) BETWEEN 4 AND 110 AND NOT {q.has(s, '[.。．,;:，]$')} AND {q.size(words(q, s))} >= 2 AND {caption_kind(q, s)} IS NULL)"


def bare_number(q: Spark, t: str) -> str:
    """A number of at most four digits and nothing else: a page's, a line's."""
    return q.has(t, rf"^[{WS}]*[0-9]{{1,4}}[{WS}]*$")


def own_equation_number(q: Spark, t: str) -> str:
    """The number in brackets that is all of a text, or null."""
    found = q.first(trimmed(q, t), r"^\(([0-9][0-9A-Za-z.]{0,4})\)$", 1)
    return f"(CASE WHEN {found} <> '' THEN {found} END)"


def local_address(q: Spark, t: str) -> str:
    """An address on this machine: what is sent there stays."""
    return q.has(t, r"^(?:[^:]*://)?(?:localhost|127\.0\.0\.1)(?:[/:]|$)")


def version_key(q: Spark, t: str) -> str:
    """A version's three numbers as one that compares like them, or null; what is no number after the second counts as 0."""
    pattern = rf"^[{WS}]*[vV]*([0-9]{{1,5}})[.+-]([0-9]{{1,5}})(?:[.+-]([0-9]{{1,5}}))?(?:[.+-]|[{WS}]*$|[.+-].*$)"
    part = lambda k: f"coalesce({q.big(q.first(t, pattern, k))}, 0)"
    return f"(CASE WHEN {q.has(t, pattern)} THEN {part(1)} * 10000000000 + {part(2)} * 100000 + {part(3)} END)"


def font_family(q: Spark, t: str) -> str:
    """A font's family in small letters: without the mark of a subset."""
    return f"lower({q.replace(t, r'^[A-Z]{6}\+', '')})"


def slug(q: Spark, t: str) -> str:
    """A name for a file: letters, digits, hyphens and stops; all else an underscore."""
    return q.replace(t, "[^A-Za-z0-9.-]", "_")


def half_ems(q: Spark, t: str) -> str:
    """A text's advance in half ems: wide characters take two."""
    return f"(length({t}) + {q.count(t, r'[\x{2E80}-\x{10FFFF}]')})"


#: Rules that clean a text: a new text for each.
CLEANERS = {f.__name__: f for f in (trim_line_spaces, drop_control, drop_zero_width, plain_spaces, drop_soft_hyphens, japanese_stops, drop_cjk_spaces, collapse_letterspacing, web_uri, unspace_address, esc_html, esc_md, guard_line, strip_marker, image_link, alt_text, digits_key, compact_text, font_family, slug)}
#: Rules that say yes or no.
PREDICATES = {f.__name__: f for f in (is_junk, letter_spaced, url_continues, is_cjk, is_math_char, is_math_font, font_bold, font_italic, prose_like, japanese_title, is_front_heading, is_closing_heading, is_references_heading, is_refs_heading, is_references, section_word, caps_heading, is_byline, is_strong_byline, note_opening, dates_line, has_year, dated_note, is_boilerplate, is_kicker, repetitive, panel_labels, is_list_marker, has_equation_number, ends_sentence, open_end, starts_low, starts_weakly, marker_only, author_start, cjk_year, cjk_bib, initials_first, full_name, heading_word, looks_numeric, latin_text, mostly_symbols, looks_like_reference, is_japanese, translatable, num_ratio_high, tripled_word, needs_guard, has_kanji, has_hiragana, has_katakana, wants_more, opens_entry, is_equation_line, is_mathish, title_like, bare_number, local_address)}
#: Rules over single words.
WORD_PREDICATES = {f.__name__: f for f in (surname, initials, bare_initials, roman, page_token, garbled)}
#: Rules that give a value or null.
VALUES = {f.__name__: f for f in (caption_kind, numbered_heading_depth, heading_number, list_number, item_number, marker, find_year, lead, entry_end, trailing_pages, first_page, math_permille, own_equation_number, version_key, half_ems)}
