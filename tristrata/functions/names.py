"""Column-name vocabularies that steer modelling decisions."""

# The names below decide roles, keys and dates, so results depend on them exactly.

# Columns stamped by the system on every write, with no business meaning as an event date.
AUDIT_DATES = frozenset({
    "modifieddate", "modified_date", "updated_at", "updatedat",
    "last_modified", "last_modified_at", "last_updated_at", "last_updated",
    "date_modified", "modified_on", "updated_on", "rowversion", "timestamp",
    "created_at", "createdat", "datecreated", "datemodified",
    "created_on", "insert_date", "update_date", "date_created",
})

# Audit columns left out of change detection.
AUDIT_COLUMNS = frozenset({
    "last_update", "updated_at", "modified_at", "last_modified_at", "last_updated_at",
    "modified_on", "updated_on", "last_modified", "date_modified", "created_at",
    "created_on", "insert_date", "update_date", "last_updated", "date_created",
})

# Binary blobs and credentials, left out of change detection too.
TECHNICAL_COLUMNS = frozenset({
    "password", "picture", "photo", "image", "blob", "hash", "token",
    "secret", "salt", "checksum",
})

# Columns that say when a row was last changed, best first.
UPDATE_STAMPS = (
    "updated_at", "modified_at", "last_modified_at", "last_updated_at",
    "modified_on", "updated_on", "last_modified", "date_modified",
)

# Words that mark an integer column as a measure.
MEASURE_WORDS = frozenset({
    "qty", "quantity", "amount", "count", "total", "price", "cost", "value",
    "rate", "pct", "revenue", "profit", "margin", "weight", "score",
    "hrs", "hours", "days", "units", "size", "volume", "balance",
})

# Table names of entities whose attributes change over time.
TRACKED_ENTITIES = (
    "customer", "client", "employee", "staff", "user", "account",
    "vendor", "supplier", "contact", "person", "partner", "member",
)

# Foreign keys that record who touched a row rather than a business relationship.
PROVENANCE_KEYS = frozenset({
    "created_by", "updated_by", "modified_by", "last_updated_by",
    "created_by_id", "updated_by_id", "modified_by_id",
    "deleted_by", "deleted_by_id",
    "approved_by", "approved_by_id",
    "reviewed_by", "reviewed_by_id",
    "assigned_to", "assigned_to_id",
    "owned_by", "owned_by_id",
})

# Last parts of names of identifiers, and parts that hold a measure's word by chance.
IDENTIFIER_WORDS = frozenset({"id", "key", "sk", "code", "no", "number"})
NO_MEASURES = frozenset({"account", "county", "country", "counter", "daysofweek"})
