"""Classes of free text by keywords: the first class that has a word in the text holds."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of processing methods with their keywords, in order of precedence.
PROCESS_CLASSES = (
    (
        "infused_cofermented",
        (
            "co-ferment",
            "infused",
            "infusion",
            "cinnamon",
            "ginger",
            "passion fruit",
            "passionfruit",
            "strawberry",
            "peach",
            "mango",
            "pineapple",
            "coconut",
            "grapefruit",
            "raspberry",
            "lychee",
            "watermelon",
            "lavender",
            "jasmine",
            "rose",
            "kumquat",
            "osmanthus",
            "acai",
        ),
    ),
    ("barrel_aged", ("barrel",)),
    ("decaf", ("decaf", "ethyl acetate", "swiss water", "sugarcane")),
    ("anaerobic_carbonic", ("anaerobic", "anaerobes", "anaerobico", "carbonic", "maceration", "anoxic")),
    ("advanced_technical", ("thermal shock", "koji", "lactic", "yeast", "culturing", "bacteria", "nitrogen", "nitro")),
    ("honey", ("honey",)),
    ("washed", ("washed", "lavado", "washing")),
    ("natural", ("natural", "dry", "sun-dried", "sun dried", "winey")),
    ("wet_hulled", ("giling basah", "wet hulled", "wet-hulled")),
    ("advanced_technical", ("ferment", "inocul", "bioreactor", "mosto")),
    ("experimental", ("experimental",)),
)
#: Classes of varieties with their keywords, in order of precedence.
VARIETY_CLASSES = (
    ("typica", ("typica", "kona", "jamaica blue mountain", "mocha", "kent")),
    ("heirloom", ("heirloom", "landrace", "native", "wild", "forest", "pink bourbon", "bourbon ají", "wush wush", "chiroso")),
    ("bourbon", ("bourbon", "santos", "mundo novo", "caturra", "catuai", "pacas", "villa sarchi", "tekisic")),
    ("geisha", ("geisha", "gesha")),
    ("sl_varieties", ("sl ", "sl28", "sl34", "scott labs")),
    (
        "hybrid",
        (
            "hybrid",
            "f1",
            "ruiru",
            "batian",
            "castillo",
            "colombia",
            "tabi",
            "catimor",
            "sarchimor",
            "sidra",
            "marsellesa",
            "parainema",
            "centroamericano",
            "obata",
            "icatu",
            "starmaya",
            "ihcafe",
        ),
    ),
    ("large_bean", ("pacamara", "maragogype", "maragogipe", "elephant bean")),
    ("arabica_other", ("red catuai", "yellow catuai")),
)
#: Numbered SL varieties count without being listed.
NUMBERED = {"sl_varieties": r"sl[0-9]+"}


def pattern(name: str, words: tuple[str, ...]) -> str:
    return "|".join([re.escape(w) for w in words] + ([NUMBERED[name]] if name in NUMBERED else []))


def first_class(text: Column, classes: tuple, other: str = "other") -> Column:
    """Null and empty texts are of the class ``other``."""
    low, out = F.lower(text), F
    for name, words in classes:
        out = out.when(low.rlike(pattern(name, words)), name)
    return out.otherwise(other)


def process_class(text: Column) -> Column:
    return first_class(text, PROCESS_CLASSES)


def variety_class(text: Column) -> Column:
    return first_class(text, VARIETY_CLASSES)


#: Texts anywhere in a URL that no product page has.
EXCLUDED_IN_URL = (
    "v60",
    "chemex",
    "aeropress",
    "bialetti",
    "kalita",
    "hario",
    "timemore",
    "origami",
    "abaca",
    "baratza",
    "comandante",
    "wilfa",
    "bonavita",
    "moccamaster",
    "grinder",
    "tumbler",
    "shirt",
    "t-shirt",
    "tote",
    "hoodie",
    "clothing",
    "capsules",
    "capsulas",
    "compostables",
    "k-cup",
    "gift-card",
    "tarjetas-regalo",
    "giftcard",
    "subscription",
    "surprise",
    "cupping",
    "ticket",
    "workshop",
    "-tote-",
    "test-roast",
    "discovery",
    "descubrimiento",
    "equipment",
    "grinder",
    "merch",
    "merchandise",
    "checkout",
    "account",
    "login",
    "contact",
    "about",
    "shipping",
    "privacy",
    "terms",
    "admin",
    "advent",
)
#: Texts in the path of a URL that no product page has.
EXCLUDED_IN_PATH = ("/cart", "/checkout", "/account", "/login", "/contact", "/about", "/shipping", "/privacy", "/terms", "/admin", "/api")
#: A product page has one of these, unless others are asked for.
PRODUCT_PATHS = ("/product/", "/products/", "/shop/p/")
#: Marks of a kit for tasting.
KIT_MARKS = ("taster-pack", "taster_pack", "sample-pack", "sampler", "tasting-kit", "tasting-set")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, dict.fromkeys(words)))


def product_url(url: Column, required: tuple[str, ...] = PRODUCT_PATHS) -> Column:
    """Whether a URL may be a product page; null and empty ones are not."""
    low = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return low.rlike(_any(required)) & ~low.rlike(_any(EXCLUDED_IN_URL)) & ~path.rlike(_any(EXCLUDED_IN_PATH))


def kit_url(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(_any(KIT_MARKS))
