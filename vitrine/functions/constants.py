"""Weights, word lists and tables on which results depend."""

# Fixed values of search.
TEXT_WEIGHT, PHRASE_BONUS, COLOUR_BONUS, TASTE_WEIGHT = 2.5, 0.8, 0.5, 0.6
PER_BRAND, PAGE, RELEVANT_Z, MIN_USD = 2, 24, 1.5, 5.0
BM25_K1, BM25_B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3.0, "product_type": 2.0, "tags": 1.0, "description": 0.5}
DESCRIPTION_INDEXED = 300
STOP = "a an the and or for with in of to my me some that this i want looking".split()
COLOURS = (
    "black white cream ivory ecru beige tan camel brown chocolate navy blue red burgundy wine pink blush rose green olive sage khaki grey gray charcoal silver gold yellow "
    "orange rust purple lilac lavender mint oat"
).split()
JUNK = r"shipping protection|route package|customi[sz]ation|gift card|donation|sample sale ticket|deposit|e-?gift|\b[A-Z0-9_]{6,}\b"
FX = {
    "USD": 1.0, "CAD": 0.73, "GBP": 1.27, "EUR": 1.08, "AUD": 0.65, "NZD": 0.60, "JPY": 0.0067, "INR": 0.012, "KRW": 0.00073, "SEK": 0.095, "DKK": 0.145, "NOK": 0.093,
    "CHF": 1.12, "PLN": 0.25, "BRL": 0.18, "MXN": 0.055, "SGD": 0.75, "HKD": 0.128, "CNY": 0.14, "THB": 0.028, "PHP": 0.017, "IDR": 0.000063, "VND": 0.00004, "MYR": 0.21,
    "TRY": 0.03, "ZAR": 0.055, "COP": 0.00024, "PEN": 0.27, "ARS": 0.001,
}
SIZE_GROUPS = {
    "dresses": ["dress", "jumpsuit", "set"],
    "tops": ["top", "knitwear", "jacket", "coat", "blazer", "swimwear", "lingerie", "activewear"],
    "bottoms": ["trousers", "jeans", "skirt", "shorts"],
}

# Fixed values of recommendation, taste, traits, quiz, ingest and audit.
FLOOR, RELATIVE, TOP_K, REF_K, MIN_ITEMS, WHY_MAX, MASKED = 2.5, 0.85, 3, 10, 3, 3, -10.0
TASTE_MAX, TASTE_MEAN, TASTE_PENALTY, TASTE_NEG_Z = 0.6, 0.4, 0.5, 1.5
FEED_LIMIT, FEED_PER_BRAND, FEED_DEDUPE = 48, 3, 0.95
VOCAB_PER_IMAGE, VOCAB_MIN_Z, VOCAB_MAX, TRAIT_MAX_WORDS = 3, 1.5, 6, 8
QUIZ_ITERATIONS, STRONG_Z = 15, 2.5
SKIP_WORDS = ["gift card", "giftcard", "e-gift", "gift voucher"]
MAX_IMAGES, IMAGE_WIDTH, STORED_DESCRIPTION = 6, 512, 700
BANNED_TRAITS = (
    r"(?i)\b(\w*core|y2k|\d0s|vibe|vibes|aesthetic|aesthetics|chic|boho|grunge|preppy|coquette|cottage|streetwear|athleisure|quiet luxury|old money|it[- ]girl|cool[- ]girl|clean[- ]girl|"
    r"edgy|trendy|minimalist|maximalist|indie|alt|retro|vintage-inspired)\b"
)

# Fixed values of categories, and the keywords in the order of matching.
CATEGORIES = "dress top knitwear trousers jeans skirt shorts jacket coat blazer jumpsuit set swimwear lingerie activewear shoes bag accessory".split()
NON_CLOTHING = ["shoes", "bag", "accessory"]
COMPATIBLE = {c: [c] for c in CATEGORIES} | {
    "top": ["top", "knitwear", "set"], "knitwear": ["knitwear", "top"], "trousers": ["trousers", "jeans", "set"], "jeans": ["jeans", "trousers"], "skirt": ["skirt", "set"],
    "jacket": ["jacket", "coat", "blazer"], "coat": ["coat", "jacket"], "blazer": ["blazer", "jacket"], "lingerie": ["lingerie", "dress"],
}
KEYWORDS = [
    ("jumpsuit", "jumpsuit"), ("romper", "jumpsuit"), ("playsuit", "jumpsuit"), ("overalls", "jumpsuit"), ("dungaree", "jumpsuit"),
    ("swimsuit", "swimwear"), ("bikini", "swimwear"), ("swimwear", "swimwear"), ("one-piece", "swimwear"),
    ("nightgown", "lingerie"), ("lingerie", "lingerie"), ("bralette", "lingerie"), ("underwear", "lingerie"), ("brief", "lingerie"), ("thong", "lingerie"),
    ("leggings", "activewear"), ("sports bra", "activewear"), ("bike shorts", "activewear"), ("activewear", "activewear"),
    ("two-piece", "set"), ("co-ord", "set"), ("matching set", "set"), (" set", "set"),
    ("dress", "dress"), ("gown", "dress"),
    ("skirt", "skirt"), ("skort", "skirt"),
    ("shorts", "shorts"),
    ("jeans", "jeans"), ("jean ", "jeans"),
    ("trousers", "trousers"), ("trouser", "trousers"), ("pants", "trousers"), ("pant ", "trousers"), ("slacks", "trousers"), ("culotte", "trousers"), ("jogger", "trousers"),
    ("blazer", "blazer"),
    ("trench", "coat"), ("overcoat", "coat"), ("coat", "coat"),
    ("jacket", "jacket"), ("bomber", "jacket"), ("puffer", "jacket"), ("anorak", "jacket"), ("parka", "jacket"), ("gilet", "jacket"), ("vest", "jacket"),
    ("cardigan", "knitwear"), ("sweater", "knitwear"), ("jumper", "knitwear"), ("pullover", "knitwear"), ("turtleneck", "knitwear"),
    ("blouse", "top"), ("shirt", "top"), ("t-shirt", "top"), ("tee", "top"), ("tank", "top"), ("camisole", "top"), ("cami", "top"), ("bodysuit", "top"), ("corset", "top"), ("bustier", "top"), ("hoodie", "top"), ("sweatshirt", "top"), ("polo", "top"), ("crop top", "top"), ("top", "top"),
    ("sneaker", "shoes"), ("loafer", "shoes"), ("sandal", "shoes"), ("boot", "shoes"), ("heel", "shoes"), ("mule", "shoes"), ("shoe", "shoes"),
    ("tote", "bag"), ("handbag", "bag"), ("bag", "bag"),
    ("hat", "accessory"), ("belt", "accessory"), ("scarf", "accessory"), ("jewellery", "accessory"), ("jewelry", "accessory"), ("earring", "accessory"), ("necklace", "accessory"), ("sunglasses", "accessory"),
    ("denim", "jeans"),
    ("knit", "knitwear"),
    ("slip", "dress"),
]

# Fixed values of sizes.
LETTERS = "XXS XS S M L XL XXL".split()
ALIASES = {
    "xxs": "XXS", "2xs": "XXS", "xxsmall": "XXS", "xx-small": "XXS",
    "xs": "XS", "x-small": "XS", "xsmall": "XS", "extra small": "XS", "petite": "XS",
    "s": "S", "sm": "S", "small": "S",
    "m": "M", "md": "M", "med": "M", "medium": "M",
    "l": "L", "lg": "L", "large": "L",
    "xl": "XL", "x-large": "XL", "xlarge": "XL", "extra large": "XL", "1x": "XL",
    "xxl": "XXL", "2xl": "XXL", "xx-large": "XXL", "3xl": "XXL", "4xl": "XXL", "5xl": "XXL", "2x": "XXL", "3x": "XXL", "4x": "XXL",
    "os": "ONE", "o/s": "ONE", "one size": "ONE", "onesize": "ONE", "one-size": "ONE", "free": "ONE", "free size": "ONE", "u": "ONE", "uni": "ONE", "universal": "ONE", "default title": "ONE", "default": "ONE", "standard": "ONE",
}
REGIONS = {
    "GBP": "UK", "AUD": "UK", "NZD": "UK", "INR": "UK",
    "EUR": "EU", "SEK": "EU", "DKK": "EU", "NOK": "EU", "CHF": "EU", "PLN": "EU",
    "USD": "US", "CAD": "US", "MXN": "US", "BRL": "US",
    "JPY": "JP",
    "KRW": "KR",
}
NUMERIC = {
    "US": {0: "XS", 2: "XS", 4: "S", 6: "S", 8: "M", 10: "M", 12: "L", 14: "L", 16: "XL", 18: "XL", 20: "XXL", 22: "XXL", 24: "XXL"},
    "UK": {4: "XXS", 6: "XS", 8: "S", 10: "S", 12: "M", 14: "L", 16: "L", 18: "XL", 20: "XL", 22: "XXL", 24: "XXL"},
    "EU": {32: "XXS", 34: "XS", 36: "S", 38: "S", 40: "M", 42: "M", 44: "L", 46: "XL", 48: "XL", 50: "XXL"},
    "IT": {36: "XXS", 38: "XS", 40: "S", 42: "S", 44: "M", 46: "L", 48: "XL", 50: "XXL"},
    "JP": {0: "XS", 2: "XS", 4: "S", 6: "S", 8: "M", 10: "M", 12: "L", 14: "L", 16: "XL", 18: "XL", 20: "XXL", 22: "XXL", 24: "XXL"},
    "KR": {0: "XS", 2: "XS", 4: "S", 6: "S", 8: "M", 10: "M", 12: "L", 14: "L", 16: "XL", 18: "XL", 20: "XXL", 22: "XXL", 24: "XXL"},
    "WAIST": {22: "XXS", 23: "XXS", 24: "XS", 25: "XS", 26: "S", 27: "S", 28: "M", 29: "M", 30: "L", 31: "L", 32: "XL", 33: "XL", 34: "XXL", 35: "XXL", 36: "XXL"},
    "123": {0: "XS", 1: "S", 2: "M", 3: "L", 4: "XL", 5: "XXL"},
}
SHOES = r"(?i)\b(shoe|shoes|boot|boots|sandal|sandals|sneaker|sneakers|loafer|loafers|heel|heels|mule|mules|flat|flats|slipper)\b"
BOTTOMS = r"(?i)\b(jean|jeans|denim|pant|pants|trouser|trousers|short|shorts|skirt)\b"
SIZE_OPTION = r"(?iu)size|taille|größe|grösse|talla|taglia|maat|storlek|sz"
REGION_TAG = r"(?i)\b(us|uk|eu|au|it|fr|de|jp)\b"

# Fixed values of the brand audit.
SEO_WORDS = (
    r"(?i)\b(women'?s|womens|ladies|casual|loose|solid color|solid colour|new arrival|fashion|elegant|sexy|plus size|for women|hot sale|streetwear|y2k|vintage style|"
    r"korean style|harajuku|kawaii|summer|autumn|spring|winter)\b"
)
PLACEHOLDER = r"[A-Z0-9_]{6,}"
