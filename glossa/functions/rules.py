"""Cleaning rules as data: fixed values of the corpora that the cleaning is defined for."""

from __future__ import annotations

# A sentence of normalised text is dropped if it holds all strings of one of its variety's groups.
DROP_GROUPS: dict[str, list[tuple[str, ...]]] = {
    "vec": [
        ("numari romani",),
        ("numeri romani",),
        ("par rivar al cao",),
        ("el xe un comun de",),
        ("el xe on comun de",),
        ("gregorian",),
        ("xe na stasion feroviaria",),
        ("comun italian de aneme",),
        ("comune de abitanti inte",),
        ("abitanti del departemento", "in fransa"),
        ("abitanti", "departemento", "fransa"),
        ("comune fransese", "departemento"),
        ("comun italian", "abitanti"),
        ("ghe manca", "fin de l"),
        ("ghe manca", "fin del"),
        ("el xe on an", "secolo"),
        ("el xe un an", "secolo"),
    ],
    "lmo": [
        ("la stazzion de",),
        ("la stazion de",),
        ("el cumun",),
        ("el cumu",),
        ("el cumun de",),
        ("el distret",),
        ("el passaport",),
        ("el cunfina coi cumu",),
        ("al gh ha pressapoch",),
        ("l andament del numer de abitant",),
        ("l andament del nomer dei abitancc",),
        ("a l e una cita",),
        ("l e na stazion de la",),
        ("l e un cumun",),
        ("l e un cumu",),
        ("l e n cumu",),
        ("l e menziunaa la prima volta",),
        ("l e taccada a stazione di",),
        ("la a l e na strada",),
        ("a l e na ferrovia",),
        ("la se troa a na",),
        ("e na densita de",),
        ("el paes el se trova al cunfin",),
        ("altezza de meter sora el nivell del mar",),
        ("a l e una strada statal longa",),
        ("citadina todesca del stat federal",),
        ("comun de la croazzia",),
        ("statunitens representant",),
        ("austriegh del land",),
    ],
    "pms": [
        ("grup ed popolassion",),
        ("a confin a con",),
        ("a l e na comun a ed",),
        ("con na densita",),
        ("a se stend",),
        ("as destend per",),
        ("a l e na comun",),
        ("la lenga",),
        ("ne schema",),
        ("el sindich a l e",),
        ("a l e un comun",),
        ("parochia che a aparten al munissipi",),
    ],
    "lld": [
        ("ie n luech te",),
        ("ie n videojuech svilupa",),
        ("ie n chemun de la",),
    ],
    "nap": [
        ("colspan",),
        ("e nu comune e",),
    ],
    "fur": [
        ("comun di abitants logat tal",),
    ],
    "lij": [
        ("comune inta provinsa de",),
        ("comune inta cittae metropolitann",),
    ],
    "sc": [
        ("comunu de bividores",),
        ("comuna ispagnola de abitantes",),
    ],
    "scn": [
        ("cumuni di abbitanti da pruvincia",),
        ("cumuni talianu da pruvincia",),
        ("havi na pupulazzioni di abbita",),
    ],
}

# Substrings that drop a sentence of native text (vec: of its lower-cased text).
NATIVE_SUBSTRINGS: dict[str, list[str]] = {
    "vec": [
        "el xe un comun de",
        "gregorian",
    ],
    "lmo": [
        "La Stazzion de",
        "La Stazion de",
        "El cumün",
        "El cümü",
        "El cumün de",
        "El Distret",
        "El Passaport",
        "El cunfìna coi cümü",
        "km²",
        "Al gh'ha pressapoch abitant",
        "L'andament del numer de abitant",
        "L'andament del nömer dei abitàncc",
        "L'andamènt del nömer dei abitàncc",
        "a l'è una cità",
        "l'è 'na stazion de la",
        "l'è un cumün",
        "l'è un cümü",
        "l'è 'n cümü",
        "l'è menziunaa la prima volta",
        "L'è taccada a stazione di",
        "La a l'è 'na strada",
        "a l'è 'na ferrovia",
        "la se tróa a 'na",
        "e 'na densità de",
    ],
    "pms": [
        "grup ëd popolassion.",
        "A confin-a con ",
        "a l'é na comun-a ëd",
        "con na densità",
        "A së stend",
        "As dëstend për",
        "a l'é na comun",
        "La lenga",
        "Në schema",
        "Ël sìndich a l'é",
        "a l'é un comun",
    ],
}

# Regular expressions that drop a sentence of native text, letters in either case.
NATIVE_PATTERNS: dict[str, list[str]] = {
    "vec": [
        r"el xe on comun de.*abitanti del departemento.*in Fransa\.",
        r"el xe (?:on|un) comun italian de.*abitanti",
        r"\([MDCLXVI]+(?:\s+v\.C\.?)?\s+(?:en|in|par)\s+num[ae]ri\s+romani\)",
        r"\bel\s+xe\s+(?:on|un)\s+an(?:n?o)?(?:\s+\w+)?\s+(?:del|de\s+el)\s+[IVX]+\s+sec",
        r"ghe\s+manca\s+\d+\s+d[iì]\s+par\s+[lł][ae]?\s+fin\s+de\s+l['’]?\s*an(?:n?o)?\b",
        r"par\s+rivar\s+al\s+cao\s+de\s+l['’]?\s*an[oó]?\s+ghe\s+vo[lł]+e",
    ],
}

# What article cleaning removes, in this order; the second set in either case.
HEADER = r"(?<!=)=++[^=]++=++"  # possessive: a sign without a partner is looked at once
MARKUP = r"<comment>.*?</comment>|<contributor>|</contributor>|<format>.*?</format>|<ip>.*?</ip>|<minor\s*/>|<model>.*?</model>|<ns[^>]*>[^<]*</ns>|<parentid>.*?</parentid>|<revision>|<timestamp>.*?</timestamp>|<username>.*?</username>"
MARKUP_ANY_CASE = r"</math>|</poem>|</small>|<references>|</html>|</includeonly></onlyinclude>|</table>|<\?php|<BR\s+C[^>]*>|#redirect"
STRAY = r"<|br>"
#: What SQL decodes and takes out: these entities with their semicolon, &amp; with or without it, and part of the markup.
#: RE2's dot stops at line feeds only, its white space is of ASCII, and its letters have all their cases.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}
PLAIN_MARKUP = r"(?d)<comment>.*?</comment>|<revision>|<minor[\t\n\f\r ]*/>|<ns[^>]*>[^<]*</ns>"
PLAIN_MARKUP_ANY_CASE = r"(?iu)</math>|</poem>|</small>|<references>|</html>|</table>|<\?php|#redirect"

# Characters that end a sentence.
TERMINATORS = [".", "!", "?", '"', "'", "”", "’", "»", "…", ")", "]"]

# What ends a sentence, and what may close after it before the blank.
SENTENCE_END, CLOSERS = ".!?…", "\"'”’»)]"

# Letters without a decomposition, and what stands for them.
LETTERS = {"ß": "ss", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH"}

# Pairs of quotes that may surround a line.
QUOTES = [('"', '"'), ("'", "'"), ("«", "»"), ("“", "”"), ("‘", "’"), ("‹", "›"), ("「", "」")]

# Names of languages and the codes that files and columns use.
LANGUAGE_CODES = {
    "italiano": "ita", "italian": "ita", "inglese": "eng", "english": "eng", "spagnolo": "spa", "spanish": "spa", "spn": "spa",
    "francese": "fra", "french": "fra", "tedesco": "deu", "german": "deu", "veneto": "vec", "venetian": "vec",
    "siciliano": "scn", "sicilian": "scn", "sardo": "srd", "sardinian": "srd", "lombardo": "lmo", "lombard": "lmo",
    "ligure": "lij", "ligurian": "lij", "friulano": "fur", "friulian": "fur",
}

# Varieties, their families and roles, and the order of families.
VARIETIES = [
    ("fur", "italo_romance", "dialect"), ("lij", "italo_romance", "dialect"), ("lmo", "italo_romance", "dialect"),
    ("sc", "italo_romance", "dialect"), ("scn", "italo_romance", "dialect"), ("vec", "italo_romance", "dialect"),
    ("ita", "italian", "italian"), ("spa", "romance", "external"), ("fra", "romance", "external"),
    ("cat", "romance", "external"), ("por", "romance", "external"), ("oci", "romance", "external"),
    ("deu", "germanic", "external"), ("eng", "english", "external"), ("slv", "slavic", "external"),
    ("hrv", "slavic", "external"), ("hun", "uralic", "external"),
]
FAMILIES = ["italo_romance", "italian", "romance", "germanic", "english", "slavic", "uralic"]

# Historical contacts of each dialect.
CONTACTS = {"fur": ["deu", "slv", "hrv"], "lij": ["oci", "spa", "fra"], "lmo": ["deu", "oci", "spa"], "sc": ["spa", "cat", "fra"], "scn": ["spa", "fra", "cat"], "vec": ["hrv", "slv", "deu"]}

# Spelling to sound classes, by variety, in the order of application.
ITALIAN_SOUNDS = [
    ("gn", "N"), ("gli", "L"), ("ggh", "g"), ("ɖɖ", "d"), ("dd", "d"), ("cch", "k"), ("ch", "k"), ("gh", "g"),
    ("sce", "Se"), ("sci", "Si"), ("sc", "sk"), ("sch", "sk"), ("zz", "z"), ("qu", "kw"), ("c", "k"),
]
SOUNDS = {
    "ita": ITALIAN_SOUNDS,
    "fur": ITALIAN_SOUNDS,
    "lij": ITALIAN_SOUNDS,
    "lmo": ITALIAN_SOUNDS,
    "sc": ITALIAN_SOUNDS,
    "scn": ITALIAN_SOUNDS,
    "vec": ITALIAN_SOUNDS,
    "fra": [
        ("ch", "S"), ("eau", "o"), ("au", "o"), ("ou", "u"), ("oi", "wa"), ("ai", "E"), ("ei", "E"), ("eu", "o"), ("on", "o"),
        ("an", "a"), ("en", "a"), ("in", "E"), ("un", "o"), ("ill", "j"), ("gn", "N"), ("gu", "g"), ("qu", "k"),
    ],
    "spa": [("ch", "c"), ("ll", "j"), ("rr", "r"), ("qu", "k")],
    "cat": [("ny", "N"), ("ll", "L"), ("ix", "S"), ("ig", "c"), ("ç", "s")],
    "deu": [
        ("sch", "S"), ("ch", "x"), ("ck", "k"), ("ng", "N"), ("pf", "f"), ("ie", "i"), ("ei", "aj"), ("eu", "oj"), ("au", "aw"),
        ("v", "f"), ("z", "ts"), ("ä", "E"), ("ö", "o"), ("ü", "u"),
    ],
    "slv": [("nj", "N"), ("lj", "L"), ("dž", "Z")],
    "eng": [
        ("th", "t"), ("sh", "S"), ("ch", "c"), ("ph", "f"), ("ck", "k"), ("ee", "i"), ("oo", "u"), ("ea", "i"), ("ou", "aw"),
        ("ai", "ej"), ("ay", "ej"),
    ],
}

# Single letters to sound classes, after the above.
SOUND_LETTERS = {
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a",
    "è": "E", "é": "e", "ê": "e", "ë": "e",
    "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o",
    "ù": "u", "ú": "u", "û": "u", "ü": "u",
    "y": "i", "ñ": "n", "ç": "S", "ß": "s", "œ": "o", "æ": "E", "ø": "o", "ð": "d", "þ": "t",
    "č": "c", "š": "S", "ž": "Z", "ł": "l", "ń": "n", "ź": "Z", "ś": "S", "ć": "c",
    "ŋ": "N", "ɖ": "d", "ʃ": "S", "ʎ": "L", "ɲ": "N", "ʔ": "7", "ʁ": "r",
}

# Ranges of code points that a character vocabulary covers, in its order.
CODE_POINTS = [
    (0x20, 0x7F),
    (0x80, 0xFF),
    (0x100, 0x17F),
    (0x180, 0x24F),
    (0x250, 0x2AF),
    (0x300, 0x36F),
    (0x2000, 0x206F),
    (0x20A0, 0x20CF),
]
