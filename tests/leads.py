"""Labelled leads, one group for each kind of case that the linkage has to tell apart."""

COLUMNS = ("id", "full_name", "email", "phone", "company", "title", "source", "updated_at", "true_person_id")

ROWS = [
    # one mailbox, written three ways
    ("a01", "Nora Whitfield", "nora.whitfield@mailbox.example", None, "Quarry Lane LLC", "Analyst", "crm-export", "2025-01-02", "p01"),
    ("a02", "Nora Whitfield", "Nora.Whitfield+news@mailbox.example", None, "Quarry Lane", "Senior Analyst", "event-list", "2025-03-01", "p01"),
    ("a03", "N. Whitfield", "mailto:norawhitfield@mailbox.example", None, "Quarry Lane, L.L.C.", None, "form-fill", "2024-12-01", "p01"),
    # one line and a short form of the name
    ("b01", "Robert Castellan", None, "(555) 010-4411", "Harbor Tool & Die Inc.", "Buyer", "crm-export", "2025-02-01", "p02"),
    ("b02", "Bob Castelan", None, "+1 555 010 4411", "Harbor Tool and Die", None, "purchased-list", "2025-04-01", "p02"),
    # parent and child on one line
    ("c01", "Walter Inge Jr.", None, "555-010-7200", "Inge Brothers", None, "crm-export", "2025-01-01", "p03"),
    ("c02", "Walter Inge Sr.", None, "555-010-7200", "Inge Brothers", None, "crm-export", "2025-01-01", "p04"),
    # two people behind one switchboard
    ("d01", "Paula Brandt", None, "555-010-9000 x204", "Brandt Optics", None, "crm-export", None, "p05"),
    ("d02", "Paula Brandt", None, "555-010-9000 ext. 881", "Brandt Optics", None, "crm-export", None, "p06"),
    # one inbox that two people share
    ("e01", "Ivo Marsh", "info@marshfield.example", None, "Marshfield", None, "crm-export", None, "p07"),
    ("e02", "Tilda Roan", "info@marshfield.example", None, "Marshfield", None, "crm-export", None, "p08"),
    # one name, two employers
    ("f01", "Dana Orwell", "dana.orwell@northgate.example", None, "Northgate", None, "crm-export", None, "p09"),
    ("f02", "Dana Orwell", "dana.orwell@southgate.example", None, "Southgate", None, "crm-export", None, "p10"),
    # a typo without a phone: a question for a person
    ("g01", "Helena Bergstrom", "h.bergstrom@fjordworks.example", None, "Fjord Works", "VP", "crm-export", None, "p11"),
    ("g02", "Helena Bergström", None, None, "Fjord Works GmbH", "Vice President", "event-list", None, "p11"),
    ("g03", "Helena Bergstrom", "bergstrom.helena@fjordworks.example", None, "Fjord Works", None, "event-list", None, "p11"),
    # held back
    ("h01", None, None, None, "Lonely Company", None, "crm-export", None, "p12"),
    ("h02", None, None, None, None, "CHIEF EXECUTIVE OFFICER", "crm-export", None, "p13"),
    ("h03", "Only Name", None, None, "n/a", None, "crm-export", None, "p14"),
    ("h04", "unknown", "not an address", "none", "-", None, "crm-export", None, "p15"),
    # a trusted source beats a later date; a shared inbox never survives as an address
    ("i01", "Dr. Amos Lindqvist, PhD", "amos@lindqvist.example", "555-010-3300", "Lindqvist AB", "Founder", "purchased-list", "2026-01-01", "p16"),
    ("i02", "Lindqvist, Amos", "amos@lindqvist.example", "555-010-3301", "Lindqvist", "Owner", "crm-export", "2024-01-01", "p16"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in COLUMNS))
