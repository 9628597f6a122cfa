"""What changes between snapshots mean."""

from __future__ import annotations

# Type, severity, business impact, recommended action, confidence.
CHANGE_RULES = (
    ("privacy_policy_changed", "critical", "Legal & compliance risk exposure", "Re-run legal compliance review immediately", 1.0),
    ("terms_conditions_changed", "critical", "Contractual terms update risk", "Review updated terms for liability shifts", 1.0),
    ("refund_policy_changed", "critical", "Consumer protection & regulatory impact", "Verify alignment with consumer refund laws", 0.95),
    ("pricing_model_changed", "critical", "Fundamental revenue model shift detected", "Notify sales leadership & re-evaluate commercial strategy", 0.95),
    ("pricing_change", "critical", "Revenue model updated", "Notify sales & re-evaluate onboarding", 0.95),
    ("payment_method_removed", "critical", "Potential conversion block & business continuity risk", "Investigate payment gateway status", 0.9),
    ("product_page_changed", "moderate", "Core offering scope or messaging evolution", "Review product consistency with marketing materials", 0.85),
    ("product_change", "moderate", "Product portfolio count changed", "Check for new product launches or discontinuations", 0.9),
    ("checkout_flow_changed", "moderate", "Direct impact on conversion rates", "Test checkout flow for friction", 0.8),
    ("seo_score_drop", "moderate", "Reduced organic visibility and lead flow", "Schedule technical SEO audit", 0.85),
    ("homepage_copy_changed", "minor", "Routine marketing refresh", "No immediate action required", 0.7),
    ("metadata_update", "minor", "Low-level metadata adjustment", "Monitor for long-term SEO trend", 0.6),
    ("content_change", "minor", "General content update", "Review changes if convenient", 0.6),
)
# A changed page's type -> rule, in order.
PAGE_RULES = (("privacy_policy", "privacy_policy_changed"), ("terms_conditions", "terms_conditions_changed"), ("refund_policy", "refund_policy_changed"), ("pricing", "pricing_model_changed"), ("product", "product_page_changed"), ("home", "homepage_copy_changed"))
# What an unknown type means.
UNKNOWN_CHANGE = ("minor", "Unclassified change detected", "Review manually", 0.5)
