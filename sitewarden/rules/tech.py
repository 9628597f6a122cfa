"""Technology signatures."""

from __future__ import annotations

# Name, meta name and pattern of its content, script patterns, html patterns; first match wins.
CMS = (
    ("WordPress", ("generator", "WordPress"), (r"wp-content", r"wp-includes"), (r"wp-json",)),
    ("Shopify", ("shopify", None), (r"cdn\.shopify\.com",), (r"Shopify\.",)),
    ("Wix", ("generator", "Wix"), (r"static\.wixstatic\.com",), ()),
    ("Squarespace", ("generator", "Squarespace"), (r"squarespace",), ()),
    ("Webflow", ("generator", "Webflow"), (r"webflow",), ()),
    ("Drupal", ("generator", "Drupal"), (r"/sites/default", r"drupal"), ()),
    ("Joomla", ("generator", "Joomla"), (r"joomla",), ()),
)
# Name and patterns, in the order of the lists that they make.
ANALYTICS = (("Google Analytics", (r"google-analytics\.com/analytics\.js", r"googletagmanager\.com/gtag")), ("Google Tag Manager", (r"googletagmanager\.com/gtm\.js",)), ("Facebook Pixel", (r"connect\.facebook\.net/.*fbevents\.js",)), ("Hotjar", (r"static\.hotjar\.com",)), ("Mixpanel", (r"cdn\.mxpnl\.com",)), ("Segment", (r"cdn\.segment\.com",)))
PAYMENTS = (("Razorpay", (r"checkout\.razorpay\.com", r"razorpay")), ("Stripe", (r"js\.stripe\.com", r"stripe")), ("PayPal", (r"paypal\.com/sdk", r"paypal")), ("Paytm", (r"paytm", r"securegw\.paytm")), ("PhonePe", (r"phonepe",)), ("PayU", (r"payu",)))
FRAMEWORKS = (("React", (r"react", r"_react")), ("Vue", (r"vue\.js", r"vue\.min\.js")), ("Angular", (r"angular", r"ng-")), ("Next.js", (r"_next/", r"__NEXT_DATA__")), ("Nuxt", (r"_nuxt/",)), ("Svelte", (r"svelte",)))
HOSTING = (("Cloudflare", (r"cloudflare",)), ("AWS", (r"amazonaws\.com", r"cloudfront")), ("Vercel", (r"vercel",)), ("Netlify", (r"netlify",)), ("Google Cloud", (r"googleapis\.com",)), ("Azure", (r"azure",)))
