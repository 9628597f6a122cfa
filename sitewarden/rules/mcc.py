"""Merchant category codes: keywords and code bands."""

from __future__ import annotations

# Category, subcategory, code, description, keywords; the order decides ties.
MCC = (
    ("Retail", "Fashion & Clothing", "5621", "Women's Ready-to-Wear Stores", ("women", "dress", "fashion", "boutique", "bridal", "maternity")),
    ("Retail", "Fashion & Clothing", "5651", "Family Clothing Stores", ("clothing", "apparel", "jeans", "casual", "wear", "family")),
    ("Retail", "Fashion & Clothing", "5691", "Men's and Women's Clothing Stores", ("unisex", "clothing", "apparel", "fashion")),
    ("Retail", "Fashion & Clothing", "5611", "Men's and Boy's Clothing and Accessories Stores", ("men", "suits", "shirts", "ties", "menswear")),
    ("Retail", "Fashion & Clothing", "5631", "Women's Accessory and Specialty Shops", ("accessories", "handbags", "lingerie", "scarves")),
    ("Retail", "Groceries & Food", "5411", "Grocery Stores, Supermarkets", ("grocery", "supermarket", "food", "produce", "vegetables", "fruits", "organic")),
    ("Retail", "Groceries & Food", "5499", "Misc. Food Stores - Convenience Stores", ("convenience", "snack", "beverage", "kiosk")),
    ("Retail", "Groceries & Food", "5462", "Bakeries", ("bakery", "bread", "cake", "pastry", "cookies")),
    ("Retail", "Electronics & Appliances", "5732", "Electronics Stores", ("electronics", "computer", "phone", "laptop", "camera", "gadget")),
    ("Retail", "Electronics & Appliances", "5722", "Household Appliance Stores", ("appliance", "refrigerator", "washer", "dryer", "microwave")),
    ("Retail", "Home & Garden", "5712", "Furniture, Home Furnishings, and Equipment Stores", ("furniture", "sofa", "bed", "table", "chair", "decor")),
    ("Retail", "Home & Garden", "5200", "Home Supply Warehouse Stores", ("home improvement", "diy", "lumber", "building materials")),
    ("Retail", "Home & Garden", "5261", "Lawn and Garden Supply Stores", ("garden", "plants", "seeds", "fertilizer", "nursery")),
    ("Services", "Professional Services", "7372", "Computer Programming, Data Processing, and Integrated Systems Design Services", ("software", "saas", "programming", "development", "it services", "cloud", "api", "platform")),
    ("Services", "Professional Services", "8999", "Professional Services (Not Elsewhere Classified)", ("consulting", "agency", "professional", "expert")),
    ("Services", "Professional Services", "8111", "Legal Services and Attorneys", ("legal", "lawyer", "attorney", "law firm")),
    ("Services", "Financial Services", "6012", "Financial Institutions – Merchandise and Services", ("bank", "banking", "finance", "payment", "payments", "fintech", "transaction")),
    ("Services", "Financial Services", "6211", "Security Brokers and Dealers", ("investment", "trading", "stocks", "securities", "broker")),
    ("Services", "Education", "8299", "Schools and Educational Services (Not Elsewhere Classified)", ("course", "training", "learning", "education", "tutor", "class")),
    ("Services", "Education", "8220", "Colleges, Universities, Professional Schools, and Junior Colleges", ("university", "college", "degree", "campus")),
    ("Services", "Health & Beauty", "7230", "Beauty and Barber Shops", ("salon", "hair", "beauty", "spa", "barber")),
    ("Services", "Health & Beauty", "8099", "Medical Services and Health Practitioners (Not Elsewhere Classified)", ("health", "medical", "clinic", "care", "wellness")),
    ("Travel & Entertainment", "Travel", "4722", "Travel Agencies and Tour Operators", ("travel", "tour", "booking", "trip", "vacation")),
    ("Travel & Entertainment", "Travel", "7011", "Lodging - Hotels, Motels, Resorts, Central Reservation Services", ("hotel", "motel", "resort", "stay", "room")),
    ("Travel & Entertainment", "Dining", "5812", "Eating places and Restaurants", ("restaurant", "dining", "cafe", "bistro", "food")),
    ("Travel & Entertainment", "Dining", "5814", "Fast Food Restaurants", ("fast food", "burger", "pizza", "takeout", "drive-thru")),
)
# Last code of each band, and its name.
BANDS = ((1499, "Agricultural Services"), (2999, "Contracted Services"), (3299, "Airlines"), (3499, "Car Rental"), (3999, "Lodging (Hotels/Motels)"), (4799, "Transportation Services"), (4999, "Utility Services"), (5599, "Retail Outlet Services"), (5699, "Clothing Stores"), (7299, "Miscellaneous Stores"), (7999, "Business Services"), (8999, "Professional Services"), (9999, "Government Services"))
