"""Fixed values that results depend on."""

# Keywords that hint at an infringing listing.
INFRINGING_KEYWORDS = [
    "1:1", "aaa", "aaaaa", "copy", "outlet", "discount", "limited edition", "wholesale", "inspired", "cheap", "replica", "sales", "fake", "5 stars", "7 stars",
    "clearance", "copycat", "counterfeit", "counterfeits", "deal", "designer inspired", "discounted", "drop shipping", "dropshipping", "fakes", "imitate",
    "imitation", "inspired by", "knock off", "knockoff", "look alike", "look like", "lookalike", "looks like", "miror image", "mirror image", "non genuine",
    "non original", "not genuine", "not original", "not originale", "not real", "not the real", "repica", "repicas", "replicas", "reproduction", "repurposed",
    "rip off", "upcycled", "whole sale",
]

# Organisations whose names are looked for.
ORGANISATIONS = [
    "Deckers", "Philips", "Brunello_Cucinelli", "Hugo_Boss", "New_Guards", "Yves_Rocher", "Fendi", "Dolce_Gabbana", "Hublot", "Trustee", "Gucci", "Garnier",
    "Tiffany", "Tory_Burch", "Hermes", "Armani", "La_Roche_Posay", "Wella", "Bolton_Group", "Stella_McCartney", "Rimowa", "Dior", "Virbac", "Chanel", "Servier",
    "Unilever", "Louis_Vuitton", "Sergio_Rossi", "Brown_Forman", "Celine", "Kenzo", "Vibram", "Fred",
]

# Label names that count as positive, and those that count as negative.
POSITIVE_LABELS = ["Counterfeit", "Infringement", "Counterfeit Non-Commercial", "Suspicious", "Branded Packaging", "Actionable TMI", "Tester", "Copyright", "Bakery", "Copyright Infringement", "Design Infringement"]
NEGATIVE_LABELS = ["Legitimate", "Irrelevant", "Grey Market", "Fan Content", "Parasitism", "Branded Elements", "Collaboration", "Other", "Non-Collaboration", "Recycling"]

# Thresholds of the risk score by organisation; 0 means no filtering.
ORG_THRESHOLDS = {"Zagtoon": 0.7, "Brunello_Cucinelli": 0.0, "Fred": 0.0}
DEFAULT_THRESHOLD = 0.2
SAMPLE_PERCENT = 1
