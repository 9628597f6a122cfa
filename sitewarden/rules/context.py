"""Business contexts and signal classes."""

from __future__ import annotations

# Contexts in the order that decides ties.
CONTEXTS = ("ECOMMERCE_MERCHANT", "MARKETPLACE", "SAAS_PRODUCT", "FINTECH_INFRASTRUCTURE", "BLOCKCHAIN_INFRASTRUCTURE", "CONTENT_MEDIA", "DEVELOPER_PLATFORM")
# Evidence families and their terms.
EVIDENCE = {
    "developer_docs": ("api reference", "sdk", "documentation", "developer guide", "git clone", "npm install"),
    "blockchain_specific": ("validator", "consensus", "tokenomics", "smart contract", "faucet", "mainnet", "testnet", "rpc endpoint"),
    "blockchain_generic": ("blockchain", "crypto", "web3", "decentralized", "protocol"),
    "fintech": ("banking", "wealth management", "insurance", "loans", "credit card", "investing", "brokerage"),
    "saas": ("dashboard", "sign up", "log in", "pricing", "subscription", "software", "platform"),
    "ecommerce": ("add to cart", "checkout", "shipping", "store", "shop now", "buy now"),
    "content": ("blog", "news", "article", "editorial", "subscribe to newsletter", "read more"),
}
# Signal -> class; any other signal is advisory.
SIGNALS = {
    "website_liveness": "authoritative", "ssl_https_presence": "authoritative", "excessive_redirects": "authoritative", "policy_page_presence": "authoritative",
    "policy_validity": "advisory", "compliance_score": "advisory", "mcc_classification": "advisory", "content_risk_detection": "advisory",
    "domain_age": "informational", "seo_score": "informational", "business_metadata_extraction": "informational", "change_detection": "informational",
}
