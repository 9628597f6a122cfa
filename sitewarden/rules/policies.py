"""Policy pages: scored patterns, fallback patterns, navigation labels, expectations."""

from __future__ import annotations

# Policy, then (pattern, confidence); the order decides ties.
SCORED = (
    ("privacy_policy", ((r"privacy[-_]?policy", 1.0), (r"/privacy/?$", 0.9), (r"gdpr", 0.7), (r"data[-_]?protection", 0.7))),
    ("terms_condition", ((r"terms?[-_]?(and[-_]?|\&[-_]?)?conditions?", 1.0), (r"terms?[-_]?of[-_]?(service|use)", 1.0), (r"/terms/?$", 0.9), (r"/tos/?$", 0.9), (r"t\&c", 0.8))),
    ("shipping_delivery", ((r"shipping[-_]?policy", 1.0), (r"delivery[-_]?policy", 1.0), (r"/shipping/?$", 0.9), (r"/delivery/?$", 0.9), (r"dispatch", 0.6))),
    ("returns_refund", ((r"refund[-_]?policy", 1.0), (r"return[-_]?policy", 1.0), (r"/refunds?/?$", 0.9), (r"/returns?/?$", 0.9), (r"cancellation", 0.6))),
    ("contact_us", ((r"contact[-_]?us", 1.0), (r"/contact/?$", 0.9), (r"get[-_]?in[-_]?touch", 0.8))),
    ("about_us", ((r"about[-_]?us", 1.0), (r"/about/?$", 0.95), (r"who[-_]?we[-_]?are", 0.9), (r"our[-_]?story", 0.9), (r"[-/]story/?$", 0.85), (r"/company/?$", 0.85), (r"company[-_]?info", 0.8))),
    ("faq", ((r"/faq/?$", 1.0), (r"frequently[-_]?asked", 0.9), (r"/help/?$", 0.6))),
    ("product", ((r"/products?/?$", 0.9), (r"/shop/?$", 0.8), (r"/store/?$", 0.8), (r"/catalog/?$", 0.7))),
    ("solutions", ((r"/solutions?/?$", 1.0), (r"/services?/?$", 1.0), (r"/offerings?/?$", 0.9), (r"/platform/?$", 0.8), (r"/capabilities/?$", 0.7), (r"what[-_]?we[-_]?do", 0.8))),
)
# Patterns for policies that the scored ones don't find ("about" alone is not used).
FALLBACK = (
    ("privacy_policy", (r"privacy[-_]?policy", r"privacy", r"gdpr", r"data[-_]?protection")),
    ("terms_condition", (r"terms?[-_]?(and[-_]?|\&[-_]?)?conditions?", r"terms?[-_]?of[-_]?(service|use)", r"t\&c", r"tos")),
    ("shipping_delivery", (r"shipping", r"delivery", r"dispatch")),
    ("returns_refund", (r"returns?", r"refunds?", r"cancellation")),
    ("contact_us", (r"contact[-_]?us", r"contact", r"support")),
    ("about_us", (r"about[-_]?us", r"who[-_]?we[-_]?are")),
    ("faq", (r"faq", r"frequently[-_]?asked", r"help")),
    ("product", (r"products?", r"shop", r"store", r"catalog")),
    ("solutions", (r"solutions?", r"services?", r"offerings?", r"platform", r"capabilities")),
)
# Whole navigation labels.
NAV_LABELS = {"product": ("products", "product", "our products", "all products"), "solutions": ("solutions", "solution", "our solutions", "all solutions", "services", "our services")}
# Policy -> page type of the crawl.
PAGE_TYPE_OF = {"privacy_policy": "privacy_policy", "terms_condition": "terms_conditions", "shipping_delivery": "shipping_delivery", "returns_refund": "refund_policy", "contact_us": "contact", "about_us": "about", "faq": "faq", "product": "product", "solutions": "solutions"}
# Scored policies with their names, and what contexts expect of them other than "required".
SCORED_POLICIES = (("privacy_policy", "Privacy Policy"), ("terms_condition", "Terms of Service"), ("returns_refund", "Refund Policy"), ("contact_us", "Contact Page"))
EXPECTATIONS = {
    "SAAS_PRODUCT": {"returns_refund": "optional"},
    "FINTECH_INFRASTRUCTURE": {"returns_refund": "n/a"},
    "BLOCKCHAIN_INFRASTRUCTURE": {"returns_refund": "n/a", "contact_us": "optional"},
    "CONTENT_MEDIA": {"returns_refund": "n/a", "contact_us": "optional", "terms_condition": "optional"},
}
