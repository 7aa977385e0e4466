"""Values the page derives from what the visitor did."""

from pyspark.sql import functions as F

from quizlens.fixed_values import WIDTH
from quizlens.functions.values import clamp

# every character the browser counts as white space
BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
          0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
CAMPAIGN_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid"]


def device_class(width):
    return F.when(width < 768, "mobile").when(width < 1024, "tablet").otherwise("desktop")


def query_param(url, key):
    """First value of a query parameter, decoded; NULL when the URL lacks it."""
    pattern = rf"^[^?#]*\?(?:[^#]*?&)??{key}=([^&#]*)"
    value = F.regexp_replace(F.regexp_extract(url, pattern, 1), r"\+", " ")
    return F.when(url.rlike(pattern), F.coalesce(F.try_url_decode(value), value))


def campaign_params(url):
    return [query_param(url, key).alias(key) for key in CAMPAIGN_KEYS]


def page_x(client_x, window_width):
    width = F.when(window_width > 0, window_width).otherwise(1)
    return clamp(client_x / width, 0.0, 1.0)


def page_y(page_y_px, document_height, window_height):
    """Share of the document; the window height is a floor for an unlaid-out page."""
    height = F.greatest(document_height, window_height, F.lit(1))
    return clamp(page_y_px / height, 0.0, 1.0)


def block_pct(client_y, block_top, block_height):
    """Position inside the clicked block, NULL outside blocks or in empty ones."""
    return F.when(block_height > 0, clamp((client_y - block_top) / block_height, 0.0, 1.0))


def scroll_pct(scroll_y, document_height, window_height):
    """Scrolled share in whole percent, at most 100; NULL when nothing can scroll."""
    room = document_height - window_height
    share = F.floor(scroll_y / room * F.lit(100.0) + F.lit(0.5))
    return F.when(room > 0, F.least(F.lit(100), share)).cast("int")


def clean_label(data_track, aria_label, tag, alt, text):
    """What a clicked element is called: marker, image text, visible text, tag."""
    def filled(column):
        return F.nullif(column, F.lit(""))

    image = F.when(F.upper(tag) == "IMG", F.coalesce(filled(alt), F.lit("imagem")))
    # other blanks become plain spaces first, so that runs are runs of one character
    blanks = "".join(map(chr, BLANKS))
    spaced = F.translate(text, blanks, " " * len(blanks))
    visible = filled(F.regexp_replace(F.trim(spaced), "  +", " "))
    name = F.coalesce(filled(data_track), filled(aria_label), image, visible, F.lower(tag))
    return F.substring(name, 1, WIDTH["label"])
