"""Fixed values that decide results: letter tables, suffix lists, thresholds."""

# Letters of the language folded to plain letters.
FOLDED = {
    "ə": "e", "ı": "i", "ş": "s", "ç": "c", "ğ": "g", "ö": "o", "ü": "u",
    "İ": "i", "I": "i", "Ə": "e",
}

# Cyrillic letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s",
    "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n", "л": "l",
}

# Digits and symbols that stand for letters; * and & stand for none.
STAND_INS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "£": "e",
    "€": "e", "+": "t", "(": "c", "*": "", "&": "",
}

# Invisible characters.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"

# Characters between tokens, besides white space.
SEPARATORS = ",;:.!?()[]{}\"'’/|<>+=~`^"

# Suffixes cut off when a key is not found, in this order.
FALLBACK_SUFFIXES = [
    "lerimiz", "larimiz", "lerinin", "larinin", "lerin", "larin",
    "leri", "lari", "ler", "lar", "siniz", "sunuz", "siz", "suz",
    "sen", "san", "dir", "dur", "den", "dan", "nin", "nun",
]
MIN_STEM = 3

# Suffixes that make inflected forms of a root.
INFLECTIONS = [
    "lerimiz", "larimiz", "lerinin", "larinin", "leriniz", "lariniz",
    "lerine", "larina", "lerin", "larin", "lerde", "larda", "leri", "lari",
    "ler", "lar", "siniz", "sunuz", "siz", "suz", "sen", "san",
    "dirler", "dirlar", "diler", "dilar", "dir", "dur", "din", "dun",
    "den", "dan", "de", "da", "nin", "nun", "ni", "nu", "yem", "yam",
    "em", "am", "im", "um", "in", "un", "ik", "iq", "li", "lu", "siz",
]

# Letters that a digit can stand for, in the order in which subsets are formed.
LEET = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7", "g": "9", "b": "8"}
LEET_CAP = 24

# Consonants that writers put for one another.
SWAPS = [
    ("b", "p"), ("p", "b"), ("d", "t"), ("t", "d"),
    ("k", "g"), ("g", "k"), ("g", "q"), ("q", "g"),
    ("v", "f"), ("f", "v"), ("z", "s"), ("s", "z"),
    ("s", "w"), ("c", "j"), ("x", "h"), ("h", "x"),
]

# Thresholds of the steps.
BLOCK_SCORE, REVIEW_SCORE, BLOCK_SEVERITY = 0.97, 0.50, 3
CATEGORY_THRESHOLDS = {
    "identity_attack": 0.6, "insult": 0.46, "obscene": 0.6, "severe_toxicity": 0.84,
    "sexual_explicit": 0.5, "threat": 0.5, "toxicity": 0.37,
}
DEFAULT_THRESHOLD = 0.5
ADVISORY = ["severe_toxicity", "threat"]
LABELS = list(CATEGORY_THRESHOLDS)
MIN_TOXIC, MIN_LOG_ODDS, MIN_KEY = 10, 1.2, 3
MAX_SUFFIX, MIN_MINED, CLEAN_RATIO = 7, 2, 1.0
RUN_LENGTH = 3
TRAIN_SHARE, VAL_SHARE, SPLIT_SEED = 0.8, 0.1, 42
GRID_FROM, GRID_TO, MIN_SUPPORT = 20, 95, 150
MAX_TEXT, MAX_BATCH, MAX_CONTEXT = 10_000, 100, 200
AUGMENT_TARGET, AUTO_SEVERITY = 5000, 2
