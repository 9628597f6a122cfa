"""Patterns of what pages say about their business."""

from __future__ import annotations

# A mission and what is offered, the first pattern that fits; an address.
MISSION = (r"(?i)(?:mission|vision|our\s+goal|purpose)\s*:?\s*([^.!?]{20,500}[.!?])", r"(?i)(?:strive\s+to|aim\s+to|committed\s+to)\s+([^.!?]{20,500}[.!?])")
OFFERINGS = (r"(?i)(?:offerings|services|products|solutions|we\s+provide|features)\s*(?:include|are|offer)\s*:?\s*([^.!?]{20,500})", r"(?i)(?:wide\s+range\s+of)\s+([^.!?]{20,500})")
ADDRESS = r"(?i)\d{1,5}\s+[A-Za-z0-9_\s,.]+?(?:Street|St|Avenue|Ave|Road|Rd|Highway|Hwy|Square|Sq|Drive|Dr|Lane|Ln|Court|Ct|Parkway|Pkwy|Circle|Cir),\s*[A-Za-z0-9_\s]{2,}\s+\d{5,6}"
