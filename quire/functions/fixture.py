"""Hand-made lines for what the driver's documents lack: Japanese, hyphens, headings, captions, references, addresses. Invented, about boats, bread and music."""

LINES = [
    # captions and what only looks like one
    "Table 4. Sails by weight", "Table 4 compares sails by weight", "Figure 11: A dinghy", "Fig. 9 gives the chord", "図 4.1 船体", "第2表 楽器一覧", "表面は粗い", "図3(b)にまとめた", "Plate II bakes", "FIGURE 8", "Figure 6. the crust", "Plate XI. Violins",
    # section numbers
    "3.2 Kneading", "3.2 | Kneading", "4.5 litres of water", "1923 regatta", "VI. Rigging", "2) Tuning", "４．音階", "II. 材料", "11. Slow movements", "5.1.3 Yeast", "8.", "one word", "3 Oars and rowlocks", "IX. 帆",
    # spaced letters
    "B A R O Q U E", "S T R ING QU A R T E T", "A n   o l d   b o a t", "T W O", "K E E L S",
    # headings
    "BIBLIOGRAPHY", "9. Works cited", "IV. References", "引用文献", "Notes and references:", "Bibliografía", "Reference list.", "主要文献", "Summary", "ABST RACT", "Conclusion.", "付録", "Highlights:", "Acknowledgment", "Appendix C", "Funding", "Subject index", "List of tables", "General index", "Index:",
    "OVENS AND BAKERS", "OVENS AND BAKERS.", "FIVE SHIPS, TWO HARBOURS", "LOAF 12345",
    # names
    "Clara Novak and Tom Ward Hill", "G. H. Barrow, K. Lindt2, M. Ozols3", "seven loaves a day", "Maria Elena", "Jan van den Bosch, Rosa del Campo", "On the Slow Rise of Some Sour Doughs, with Notes on Their Crumb", "Ines Duarte · Olaf Berg · Yusuf Demir", "L. Marsh*, P. Quill†",
    # notes, dates, boilerplate
    "* Corresponding author: ines@port.example", "Email: baker@oven.example", "Received 2 March 2011; revised 9 April 2011", "(Accepted October 1, 1987)", "(2003年4月2日受理)", "Available online 17 August 2016", "Tel. 555 0100", "Submitted 1850", "†Present address: the harbour",
    "Copyright 1994 by the guild", "© 2015 Harbour Press", "Shared under a Creative Commons licence", "Some text. All rights reserved", "Original paper", "short  communication:", "総説", "review articles", "Downloaded from the pier", "Printed in Porto",
    # repeats and labels
    "鐘鐘", "la la la la la la", "coco", "(d) (e) (f)", "C'", "do re mi fa so la", "xyxyxy", "B1 B2",
    # items and numbers
    "▪ first oar", "(iv) fourth oar", "‣ more oars", "(mast) no", "• ", "p = q - r (7)", "compare (2b)", "F = ma (87654321)", "(A.3)",
    # ends and beginnings
    "the bread is done.", "the bread, the butter,", "a mast (of pine", "the sound of a", "to the", "船が出た。", "", "baked at noon", "and then they sailed", "; a second clause", "44 strings in all", "(a bracket opens it", "、で始まる", "\u3000段落のはじめ", "   spaces first",
    # references
    "[7] Barrow, G., 1996. On ovens.", "31. Barrow, G., Lindt, K., 1996", "(8) Ozols M, Hill TW (2004) Chords", "8.25 of a pound", "1996. Without a marker", "[44]", "9.", "Barrow, G.", "van der Meer JK, Lindt KA (1997)", "Plate C, d", "P. Q. Marsh, D. Reyes", "Lindt, Karin, 1988. On rye", "鈴木一郎，1965：帆船", "佐藤(1999)は", "運輸省，1955-1960：", "FAO (1998)", "forthcoming.", "Quarterly of Bread 7, 101-118.", "doi:10.5555/loaf", "found in 10.5555/44", "https://crust.example/rye", "submitted", "from 1699 to 2031", "opus 1888b", "the 18881 and 20209", "type 1990GT", "Bakers' J. 9(2): 33–41.",
    # contents and index rows
    "The Long Voyage . . . 88", "fugue, 31, 40-42", "spars 9b,", "xiv", "see sails", "flour 21 22", "Rowing 77t", "88", "ix", "vivid", "DCC", "XIX", "VIIII", "Masts and yards ........ 101", "rye bread, 5, 17-19, 60",
    # numbers, broken words
    "2,468.0", "31 ± 4", "7.25e2", "n/a", "(8)", "9 × 104", "some 3 × 10-12 of 40 km2, or 7 m3 and 9 m22", "cr•st", "B12", "f1our", "baQer", "1oaf", "fine.word", "unwr,itten", "MacDonald", "xyZ", "kn¢ad",
    # addresses
    "www.harbour.example/list_", "at doi.org/10.5-", "http://s.t/ u", "look at www . oven . example for more", "http://m.n /o p q", "file://www.harbour.example/tides", "file:///D:/rye.txt", "file:tide.example/now", "an inland place",
    # markup
    "<i>loud & \"soft\"</i>", "c * d _ e `f` \\ g", "[bread](knife) and <crumb> < 5", "# oven", "> echo", "| dough |", "* star", "-7", "***", "-----", "5. loaf", "7.5", "9876543210. y", "- dash", "42) z", "6)", "~ wave", "+7",
    "a caption that will not come to its end before it has named every kind of bread that was ever baked along that long coast, yes", "[q] \"r\" s", "Harbour (old)#2?", "\u00a0hard\u2009thin\u202fspace", "no\u200bjoin\ufeff", "fla\u00adky", "ring\u0007ring\ttab", "\ufffd\ue001", "b\ufffd", "The Harbour Bakers and Their Quarterly Review", "The Harbour Bakers and Their Quarterly Reviews", "The Harbour Baker and Their Quarterly Review",
    # Japanese and mixed
    "音 楽 と 船", "音楽, 船. 港", "これは文であり、点がある。", "漢字仮名混在長文句読点無", "パン and butter in English", "B号船とその帆", "1923年の航海", "C3船", "Δεζ = y", "p ≥ q", "Our our our boat", "Row Row Row boat", "row row row", "2 2 2",
    # formulas, versions, addresses here
    "p + q = r (4)", "∑ w = 1", "(5a)", "(2.3)", "x ≤ 4", "y = mx + b and more text that goes on without a number", "v3.4.2", "0.12", "5.0.1-beta", "2.x", "V1.0", "http://localhost:8080/x", "127.0.0.1/y", "https://localhost.example/", "The Second Harbour", "of oars and", "loaves (and", "see also rye;", "QWERTY+Caslon-Bold", "my file: one/two.txt",
    # reference-like and fonts
    "Writer Y (1998) Song. Annals 7(1):9–21", "(1998a) chord: 2-3", "21 43 65 87", "1 x 2 y 3 z", "1/8 of 2 - 3 + 4", "CMSY7", "XITSMath-Bold", "Lato-Regular", "Caslon-Semibold", "Ov.B", "Optima-BoldOblique", "Gill,bd", "Bembo-It", "Zz.bi", "港町", "row-", "long-keeled boat", "Ann's oar", "D'Angelo", "un-\u00adtuned", "crème brûlée", "Übermut und Öl",
]

#: Versions of programs.
VERSIONS = ["v1.4.2", "1.4.10", "0.9", "2.0.0-rc1", "2.0", "nightly", "1.4"]
#: (font, glyph) as page sources name them.
GLYPHS = [("QWERTY+Caslon", "g1"), ("Optima", "g1"), ("Optima", "equals"), ("Bembo", "radical.alt"), ("Bembo", "uni20AC"), ("Bembo", "u1D11E"), ("Bembo", "uE100"), ("Bembo", "uni0007"), ("Bembo", "loaf")]
#: (file_id, title, author, year) of files that match no record.
TITLES = [(1, "supplement", "T", 1991), (2, "chapter", "A", 1992), (3, "plates", "O", 1993), (4, "undated", "T", None), (5, "others", "E", 1994), (6, "more", "T", 1990), (7, "notes", "O", 1990), (8, "errata", "S", 1991), (9, "index", "D", 1992)]
#: (doc_id, node_ix, kind, level, text): formulas and their numbers.
NODES = [(1, 0, "paragraph", 0, "We sail by"), (1, 1, "formula", 0, "v = s / t"), (1, 2, "paragraph", 0, "(1)"), (1, 3, "formula", 0, "e = h"), (1, 4, "page", 0, ""), (1, 5, "item", 0, " (2a) "), (1, 6, "item", 0, "(3)"), (1, 7, "paragraph", 0, "(see 4)"), (2, 0, "item", 0, "(1)"), (2, 1, "formula", 0, "x"), (2, 2, "formula", 0, "y"), (2, 3, "paragraph", 0, "(7.1)")]
#: (doc_id, node_ix, text): headings, some of which lost their numeral.
HEADINGS = [(1, 0, "I．帆"), (1, 3, "．船体"), (1, 5, ".  港と町"), (1, 8, "IV．結び"), (1, 9, ".not this"), (1, 11, "．補い"), (2, 0, "I．パン"), (2, 1, "．粉"), (3, 0, "．はじめ"), (3, 1, "II．音"), (3, 2, "III．弦"), (3, 4, "．弓")]

#: A document with a list of references, and one with a table.
REFERENCES = ["Bread is old.", "References", "Barrow, G., 1996. On ovens and their heat.", "Quarterly of Bread 7, 101-118.", "Duarte, I., Berg, O., 2003. Masts of pine. Sails 12, 4-19.", "Lindt, K., 1988. On rye. Harbour Press, Riga.", "Marsh, P.Q., Reyes, D., 2011. Tuning by ear and by", "hand. Annals of Music 3, 55-71.", "[5] Novak, C., 2016. The fifth loaf. Crusts 1, 1-2.", "Appendix A", "After the list."]
TABLE = ["loaf | flour | hours", "rye | 500 | 12", "wheat | 450 | 3", "spelt | 480", "A line without bars", "1. Flour goes in first", "2. Water goes in second", "3. Salt goes in third"]
#: (doc_id, page, line_ix, x0, y0, x1, y1, size, text): a large initial, a section number apart from its title, a formula in two pieces, and a margin of line numbers.
PLACED = [(-4, 0, 0, 50.0, 40.0, 70.0, 70.0, 30.0, "B"), (-4, 0, 1, 72.0, 40.0, 250.0, 50.0, 10.0, "read rises slowly in the cold"), (-4, 0, 2, 72.0, 55.0, 250.0, 65.0, 10.0, "of the morning and is baked"), (-4, 0, 3, 50.0, 100.0, 65.0, 110.0, 10.0, "4.2"), (-4, 0, 4, 75.0, 100.0, 160.0, 110.0, 10.0, "Ovens and fires"), (-4, 0, 5, 50.0, 150.0, 200.0, 160.0, 10.0, "p + q ="), (-4, 0, 6, 50.0, 162.0, 200.0, 172.0, 10.0, "r + s (4)"), (-4, 0, 7, 50.0, 200.0, 200.0, 210.0, 10.0, "and the rest of it follows"), (-4, 0, 90, 50.0, 5.0, 150.0, 15.0, 8.0, "Annals of Bread 7"), (-4, 1, 90, 50.0, 5.0, 150.0, 15.0, 8.0, "Annals of Bread 8")]
PLACED += [(-4, 1, 10 + k, 10.0, 40.0 + 20 * k, 25.0, 50.0 + 20 * k, 8.0, str(5 * k + 5)) for k in range(10)] + [(-4, 1, 30 + k, 50.0, 40.0 + 20 * k, 290.0, 50.0 + 20 * k, 10.0, f"line of a manuscript that has the number {5 * k + 5}") for k in range(10)]
#: (doc_id, page, line_ix, char_ix, c, x0, y0, x1, y1, size): a raised and a lowered number.
CHARACTERS = [(-5, 0, 0, k, c, 10.0 + 6 * k, y, 16.0 + 6 * k, y + h, h) for k, (c, y, h) in enumerate([("k", 20.0, 10.0), ("m", 20.0, 10.0), ("2", 18.0, 6.0), (" ", 20.0, 10.0), ("H", 20.0, 10.0), ("2", 26.0, 6.0), ("O", 20.0, 10.0)])]

#: Formulas in LaTeX, one of them beyond what is read.
FORMULAS = [(r"\frac{a}{2} + x_i^2 = \sqrt{b}",), (r"v \leq 3.5 \times 10^{4}",), (r"\sum_{k} \alpha_k",), (r"\begin{array}x\end{array}",), (r"{a",)]
#: Japanese texts, and how often each is repeated: clean ones, and such as recognition misreads.
JAPANESE = [("港の船は朝に出て、夕方にもどる。パンを焼く人がいる。", 60), ("ヨッ卜の帆は風ヒ力を受ける。船Lの人は海Il図を見る。", 80), ("データ一覧と「A案」", 3)]
#: (doc_id, node_ix, kind, level, spans of (text, strong)): headings that paragraphs have swallowed.
STYLED = [
    (1, 0, "paragraph", 0, [("Harbour Institute of Bread", True)]), (1, 1, "heading", 2, [("Ovens", False)]), (1, 2, "paragraph", 0, [("Old Fires and New", True)]), (1, 3, "paragraph", 0, [("Fires are lit at four. See Figure 2. ", False), ("2.1 The Second Loaf", True)]),
    (1, 4, "paragraph", 0, [("3.1 ", True), ("The Third Loaf", True)]), (1, 5, "item", 0, [("3. flour", False)]), (1, 6, "paragraph", 0, [("4. Salt and Water", True)]), (1, 7, "paragraph", 0, [("It is ", False), ("never", True), (" late.", False)]), (1, 8, "paragraph", 0, [("The End of It,", True)]), (1, 9, "paragraph", 0, []),
]
