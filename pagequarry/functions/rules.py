"""Rule tables.

Everything here is data, not logic: word lists, CSS selectors, scores and
limits.  Every extractor takes its table as a parameter, so another language or
another field needs a new list and no new code.
"""

# ---- Fixed values: results depend on these exact entries and on their order.

EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_REJECT_SUFFIXES = [".png", ".jpg", ".gif", ".svg"]
EMAIL_REJECT_PREFIXES = ["http://", "https://"]
EMAIL_REJECT_CHARS = ["%", "&", "=", ";"]
CONTACT_LINK_WORDS = ["contact", "kontakt", "impressum"]

IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico"]

LOGO_SELECTORS = [
    "img.logo", ".logo img", "#logo img", "img#logo",
    ".header img", ".navbar-brand img", ".site-logo img",
    'img[alt*="logo" i]', 'img[src*="logo" i]',
    ".logo a img", "header .logo img", "a.logo img",
    ".brand img", ".branding img", ".site-header img",
    'img[alt*="site" i]', 'img[alt*="brand" i]',
    'img[src*="brand" i]', "a.navbar-brand img",
    "header a img", "#header img",
]
LOGO_SCORES = {
    "base": 50, "alt": 20, "src": 15, "class": 15, "size": 10, "home_link": 15,
    "icon": 10, "og_image": 30, "json_ld": 80,
}
LOGO_WIDTH = (20, 400)
LOGO_HEIGHT = (20, 200)

TITLE_TAIL_PATTERN = r"[-–|]\s*(.+?)$"
NAME_TITLE_SCORE = 70
NAME_JSONLD_SCORE = 90
NAME_JSONLD_ORG_SCORE = 85
NAME_HEADER_RULES = [
    ("h1", 60), (".site-title", 75), (".brand", 65), (".company-name", 80),
    ("header h1", 70), (".logo-title", 75), (".site-name", 75),
]
NAME_META_RULES = [
    ("og:site_name", 80), ("application-name", 75),
    ("twitter:title", 65), ("og:title", 60),
]
NAME_DOMAIN_SCORE = 30
NAME_LENGTH = (2, 50)

SERVICE_SECTION_SELECTORS = [
    ".services", "#services", ".service-list", ".offerings",
    'section[id*="service" i]', 'div[class*="service" i]',
    ".what-we-do", ".products", "ul.services-list",
    'div[id*="service" i]', ".service-area", ".our-services",
    'div[class*="leistung" i]', 'section[id*="leistung" i]',
    'div[id*="angebot" i]', 'section[id*="angebot" i]',
    'section[class*="leistung" i]', ".leistungen", "#leistungen",
    ".angebote", "#angebote", ".kompetenzen", "#kompetenzen",
    ".produkte", "#produkte", ".expertise", "#expertise",
    ".service-items", ".card-services", ".service-cards",
    'div[class*="service-item" i]', 'div[class*="dienstleistung" i]',
    'section[class*="dienstleistung" i]', ".dienstleistungen",
    "#dienstleistungen",
]
SECTION_ITEM_TAGS = ["li", "h3", "h4", "h5", "p"]
SECTION_ITEM_LIMIT = 10
CARD_CLASSES = ["card", "box", "item", "service-item", "service-box", "feature-box"]
CARD_LIMIT = 8
CARD_TITLE_TAGS = ["h2", "h3", "h4", "h5"]
CARD_TITLE_CLASSES = ["title", "card-title", "service-title", "heading"]
GRID_WORDS = ["row", "grid", "flex", "container"]
GRID_ITEM_CLASSES = ["col", "card", "box", "item", "service-item", "grid-item"]
GRID_ITEM_CLASS_PART = "col-"
GRID_ITEM_LIMIT = 8
HEADING_LIMIT = 20
SIBLING_LIST_LIMIT = 12
SIBLING_DIV_TAGS = ["p", "li", "h4", "h5"]
SIBLING_DIV_LIMIT = 12
PARAGRAPH_LIMIT = 30

SERVICE_HEADING_KEYWORDS = [
    "service", "leistung", "angebot", "offering", "solution",
    "dienstleistung", "produkt", "capability", "kompetenzen",
    "expertise", "wir bieten", "angebote", "solutions",
    "unsere leistungen", "was wir tun", "what we do",
]
SERVICE_PHRASES = [
    "we offer", "our services", "wir bieten", "unsere leistungen",
    "our products", "our solutions", "our expertise",
    "unsere produkte", "unsere angebote", "unsere kompetenzen",
    "what we do", "was wir tun", "how we help", "wie wir helfen",
]
PARAGRAPH_SEPARATORS = [",", "•", "|", ";", ".", "/", "–", "-"]
DESCRIPTION_SEPARATORS = [",", "•", "|", ";", "/", "&", "and", "und"]
DESCRIPTION_PATTERNS = [
    r"(?:we offer|wir bieten|our services|unsere leistungen)[:\s]+([^.]+)",
    r"(?:specialist in|spezialisiert auf|experts in|experten für)[:\s]+([^.]+)",
]
BOILERPLATE_WORDS = [
    "home", "contact", "about", "menu", "search", "login", "register",
    "startseite", "kontakt", "über uns", "anmelden", "registrieren",
    "cookie", "privacy", "datenschutz", "impressum", "agb", "faq",
    "read more", "learn more", "mehr erfahren", "mehr lesen",
    "submit", "send", "download", "blog", "news", "article", "post",
    "abschicken", "senden", "herunterladen", "artikel", "nachricht",
    "click here", "hier klicken", "next", "previous", "weiter", "zurück",
    "aktuelles", "termine", "events", "veranstaltungen",
]
SERVICE_LENGTH = (3, 120)
SERVICE_PART_LENGTH = (3, 80)
SERVICE_SIMILARITY = 0.8
CONTAINMENT_SIMILARITY = 0.9
SERVICE_LIMIT = 15

LEAD_COLUMNS = ["url", "email", "logo", "business_name", "services", "error"]
SITE_URL_COLUMNS = ["template_url", "elegant_url", "minimalist_url", "modern_url"]
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
STYLES = [
    # name, primary, secondary, accent, font, css class
    ("modern", "#4285F4", "#34A853", None, "'Roboto', sans-serif", "modern-template"),
    ("elegant", "#333333", "#B8860B", None, "'Playfair Display', serif", "elegant-template"),
    ("minimalist", "#000000", "#FFFFFF", "#F44336", "'Open Sans', sans-serif", "minimalist-template"),
]
SITE_ID_PREFIX = "ljif"
LOG_RETENTION = 50
ERROR_PREVIEW = 10

# ---- Deployment settings of this library; override per call.

SITE_BASE_URL = "https://sites.example.com"
SUBDOMAIN_BASE = "example.com"
DOCUMENT_ROOT = "/srv/sites"
