"""Word lists, patterns and tables that results depend on. Kept as text, in natural order."""

HEIDEGGER_TERMS = """
erschlossenheit befindlichkeit geworfenheit eigentlichkeit uneigentlichkeit vorhandenheit zuhandenheit mitsein dasein
zeitlichkeit geschichtlichkeit weltlichkeit sorge schuld entschlossenheit wiederholung augenblick vorlaufen gewesenheit
gegenwärtigen gewärtigen verstehen auslegung rede gerede neugier zweideutigkeit verfallenheit angst furcht langeweile
stimmung befindlich lichtung gestell ereignis kehre gelassenheit grundstimmung unverborgenheit seinsgeschichte
""".split()

KANT_TERMS = """
vernunft verstand anschauung urteilskraft pflicht kategorisch imperativ transzendental apriorisch erkenntnis erscheinung
noumenon ding einbildungskraft sinnlichkeit empfindung wahrnehmung
""".split()

HEGEL_TERMS = "geist aufhebung dialektik synthese entfremdung selbstbewusstsein absolut vermittlung wirklichkeit".split()

HUSSERL_TERMS = "intentionalität epoché reduktion lebenswelt noesis noema konstitution evidenz".split()

GENERAL_GERMAN_TERMS = """
wissenschaft grundlegung weltanschauung vorstellung bestimmung begrifflichkeit zusammenhang beziehung freiheit wahrheit
sein seiende nichts wesen bedeutung sinn zweck grund ursache wirkung vorurteil bildung erfahrung geschichte natur kultur
gesellschaft gemeinschaft freundschaft eigenschaft grundsätzlichkeit freundlichkeit möglichkeit notwendigkeit widerspruch
gegensatz einheit vielheit allgemeinheit besonderheit einzelheit substanz subjekt objekt bewusstsein unbewusstes trieb
wille macht
""".split()

FRENCH_TERMS = """
autrement visage infini totalité altérité jouissance fécondité proximité responsabilité substitution signification
conscience différence présence absence parole écriture discours
""".split()

GREEK_TERMS = """
aletheia phronesis episteme techne theoria praxis ousia eidos logos nous psyche pneuma arche telos dynamis energeia
entelecheia eudaimonia arete sophia doxa noesis
""".split()

TERM_LISTS = {
    "heidegger": HEIDEGGER_TERMS,
    "kant": KANT_TERMS,
    "hegel": HEGEL_TERMS,
    "husserl": HUSSERL_TERMS,
    "german": GENERAL_GERMAN_TERMS,
    "french": FRENCH_TERMS,
    "greek": GREEK_TERMS,
}

#: Terms that are never garbled.
VALID_TERMS = sorted({w for words in TERM_LISTS.values() for w in words})

#: Short words that are never garbled.
VALID_SHORT = sorted(set("""
a i à y ô le la de du un en et ou au il je tu on ce se ne the of to in is it an as at be by or so we if my up no do
ad ex ab
""".split()))

#: Endings that excuse a run of consonants.
GERMAN_SUFFIXES = ["keit", "heit", "ung", "schaft", "lich", "isch", "tum", "nis"]

#: Characters cut from both ends of a token.
EDGE_PUNCTUATION = ".,;:!?()[]{}\"'-–—"

#: Characters deleted anywhere in a token before the dictionary is asked.
DELETED_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "–—‘’“”…"

VOWELS = "aeiouyàáâãäåèéêëìíîïòóôõöùúûüæœ"

#: Tokens that are references, numbers and the like: (pattern, the case counts, the rest of the token is free).
REFERENCE_PATTERNS = [
    (r"\d+", True, False),
    (r"\d{1,4}[-–—]+\d{1,4}", True, False),
    (r"[ivxlcdm]+", False, False),
    (r"\d{4}", True, False),
    (r"[A-Z]\d+", True, False),
    (r"\d+[a-z]?", True, False),
    (r"ISBN", False, True),
    (r"\d{1,3}\.\d", True, True),
    (r"[A-Z]{2,4}\d", True, True),
    (r"pp?\.\s*\d", False, True),
    (r"\(\d+\)", True, False),
    (r"\[\d+\]", True, False),
    (r"§\d", True, True),
    (r"\d+[a-z]?[-–—]+\d+[a-z]?", True, False),
    (r"[\d][\d\-–—]+[\d]", True, False),
    (r"\d[\d.\-–—/]+\d", True, False),
]

#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
SOFT_HYPHEN = "­"

#: Names that keep their hyphen at a line break.
HYPHENATED_NAMES = ["merleau-ponty", "sartre-beauvoir", "buber-rosenzweig"]

#: Weights of the composite score with and without word confidences, and the floor of each signal.
WEIGHTS_WITH_CONFIDENCE = {"garbled": 0.4, "dictionary": 0.3, "confidence": 0.3}
WEIGHTS_WITHOUT_CONFIDENCE = {"garbled": 0.55, "dictionary": 0.45}
FLOORS = {"garbled": 0.5, "dictionary": 0.4, "confidence": 0.3}

STRUGGLES = ["bad_scan", "character_confusion", "vocabulary_miss", "layout_error", "language_confusion", "signal_disagreement", "gray_zone", "surya_insufficient"]

#: Languages: ISO code, first engine's code, second engine's code.
LANGUAGES = [("en", "eng", "en"), ("fr", "fra", "fr"), ("el", "ell", "el"), ("la", "lat", "la"), ("de", "deu", "de")]
DEFAULT_LANGUAGES = ["en", "fr", "el", "la", "de"]

# Patterns of the issue types, in the order in which the first match wins (after the share of letters).
CONSONANT_RUN = "[bcdfghjklmnpqrstvwxz]{6,}"
SYMBOL_RUN = "[^\\p{L}\\p{M}\\p{N}_\\s.,;:!?'\"\\-–—…*()]{3,}"
WEIRD_CASE = r"(?:^|[^\p{L}\p{N}_])[A-Z][a-z]+[A-Z][a-z]*(?:$|[^\p{L}\p{N}_])"
CONTROL_CHARACTER = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
