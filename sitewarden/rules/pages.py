"""Page types: patterns, priorities, cache lifetimes."""

from __future__ import annotations

# Type, then (pattern, weight) for url paths and for anchor or title texts. The order decides ties.
PAGE_PATTERNS = (
    ("privacy_policy", ((r"privacy[-_]?policy", 1.0), (r"/privacy/?$", 0.9), (r"gdpr", 0.8), (r"data[-_]?protection", 0.8)), ((r"privacy\s*policy", 1.0), (r"privacy", 0.6), (r"data\s*protection", 0.7))),
    ("terms_conditions", ((r"terms[-_]?(and[-_]?)?conditions?", 1.0), (r"terms[-_]?of[-_]?(service|use)", 1.0), (r"/terms/?$", 0.9), (r"/tos/?$", 0.9), (r"t-?and-?c", 0.8)), ((r"terms\s*(and|&)?\s*conditions?", 1.0), (r"terms\s*of\s*(service|use)", 1.0), (r"terms", 0.5))),
    ("refund_policy", ((r"refund[-_]?policy", 1.0), (r"return[-_]?policy", 1.0), (r"/refunds?/?$", 0.9), (r"/returns?/?$", 0.9), (r"cancellation", 0.7)), ((r"refund\s*policy", 1.0), (r"return\s*policy", 1.0), (r"refund", 0.6), (r"cancellation", 0.5))),
    ("shipping_delivery", ((r"shipping", 0.9), (r"delivery", 0.9), (r"dispatch", 0.7)), ((r"shipping\s*(policy|info)", 1.0), (r"delivery\s*(info|policy)", 1.0), (r"shipping", 0.6))),
    ("about", ((r"about[-_]?us", 1.0), (r"/about/?$", 0.95), (r"who[-_]?we[-_]?are", 0.9), (r"our[-_]?story", 0.9), (r"[-/][a-z]+-story/?$", 0.85), (r"/company/?$", 0.85), (r"/story/?$", 0.8)), ((r"about\s*us", 1.0), (r"who\s*we\s*are", 0.9), (r"our\s*story", 0.85), (r"^company$", 0.8))),
    ("contact", ((r"contact[-_]?us", 1.0), (r"/contact/?$", 0.9), (r"support", 0.6), (r"help", 0.5)), ((r"contact\s*us", 1.0), (r"get\s*in\s*touch", 0.9), (r"contact", 0.6))),
    ("pricing", ((r"/pricing/?$", 1.0), (r"/plans?/?$", 0.9), (r"/packages?/?$", 0.8)), ((r"pricing", 1.0), (r"plans?\s*(and|&)?\s*pricing", 1.0), (r"plans", 0.6))),
    ("product", ((r"/products?/?$", 0.9), (r"/shop/?$", 0.8), (r"/store/?$", 0.8), (r"/catalog/?$", 0.7), (r"/features?/?$", 0.7)), ((r"products?", 0.7), (r"features?", 0.6), (r"shop", 0.5))),
    ("solutions", ((r"/solutions?/?$", 1.0), (r"/services?/?$", 1.0), (r"/offerings?/?$", 0.9), (r"/platform/?$", 0.8), (r"/capabilities/?$", 0.7), (r"/what[-_]?we[-_]?do/?$", 0.8)), ((r"^solutions?$", 1.0), (r"^services?$", 1.0), (r"our\s*solutions?", 0.9), (r"our\s*services?", 0.9), (r"what\s*we\s*(do|offer)", 0.8), (r"platform", 0.6))),
    ("faq", ((r"/faq/?$", 1.0), (r"frequently[-_]?asked", 0.9), (r"/help/?$", 0.6)), ((r"faq", 1.0), (r"frequently\s*asked", 0.9), (r"questions", 0.4))),
    ("docs", ((r"/docs?/?$", 0.9), (r"/documentation/?$", 1.0), (r"/api/?$", 0.7), (r"/guide/?$", 0.7)), ((r"documentation", 1.0), (r"docs", 0.8), (r"api\s*reference", 0.8))),
    ("blog", ((r"/blog/", 1.0), (r"/blog/?$", 1.0), (r"/news/", 0.9), (r"/news/?$", 0.8), (r"/articles?/", 0.8), (r"/articles?/?$", 0.7), (r"/insights/", 0.7), (r"/resources/", 0.6), (r"/webinars?/", 0.6)), ((r"blog", 1.0), (r"news", 0.6))),
)
# Types that a content url can't have.
POLICY_LIKE = ("about", "contact", "privacy_policy", "terms_conditions", "refund_policy", "shipping_delivery", "faq", "product", "pricing", "solutions")
# Urls of content pages.
CONTENT_URLS = (r"/blog/", r"/blogs/", r"/news/", r"/article/", r"/articles/", r"/post/", r"/posts/", r"/insights/", r"/resources/", r"/webinars?/", r"/events?/", r"/press/", r"/media/", r"/case[-_]?stud(y|ies)/")
# Urls that are never pages.
SKIP_URLS = (r"\.pdf$", r"\.jpg$", r"\.png$", r"\.gif$", r"\.css$", r"\.js$", r"/cdn[-_]cgi/", r"javascript:", r"mailto:", r"tel:", r"#")
# Crawl priorities; any other type has 10.
PRIORITY = {"home": 100, "privacy_policy": 95, "terms_conditions": 95, "refund_policy": 90, "about": 85, "contact": 80, "pricing": 75, "product": 70, "solutions": 70, "shipping_delivery": 65, "faq": 50, "docs": 40, "blog": 20, "other": 10}
# Seconds that a cached page is valid; any other type has that of "other".
TTL = {"privacy_policy": 604800, "terms_conditions": 604800, "about": 86400, "contact": 86400, "product": 86400, "pricing": 86400, "home": 21600, "other": 3600}
# Query parameters that normalisation keeps.
PRESERVED_PARAMS = ("p", "page", "id", "product", "category")
