"""The catalogue of the 20 fields that a bid's record has, and constants of retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOP_K, LEXICAL_FLOOR, RRF_K = 6, 2, 60
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CHUNK_SIZE, CHUNK_OVERLAP, BREAK_REACH = 1000, 200, 50
EMBEDDING_DIM = 256

#: Groups of fields, in the order in which a model is asked for them.
GROUPS = ("identity", "schedule", "terms", "products", "specifications", "contacts_summary")


@dataclass(frozen=True)
class Field:
    """A field of the record: aliases are what retrieval looks for, the question is for semantic search.

    kind is string, datetime, list or contact; many tells that all records or candidates contribute to the value.
    """

    position: int
    name: str
    label: str
    group: str
    kind: str
    many: bool
    aliases: tuple[str, ...]
    question: str


# The fields of the record.
FIELDS = (
    Field(
        1, "bid_number", "Bid Number", "identity", "string", False,
        ("Solicitation Number", "RFP Number", "Bid Number", "Reference Number"),
        "The unique alphanumeric identifier assigned to this solicitation or bid.",
    ),
    Field(
        2, "title", "Title", "identity", "string", False,
        ("Project Title", "Title of Bid", "Description of Work"),
        "The title or name of the project, bid, or solicitation.",
    ),
    Field(
        3, "due_date", "Due Date", "schedule", "datetime", False,
        ("Due Date", "Closing Date", "Solicitation Due", "Bid Opening Date", "Deadline for Submission"),
        "The exact date and time when the bids or proposals are due and must be submitted.",
    ),
    Field(
        4, "bid_submission_type", "Bid Submission Type", "terms", "string", False,
        ("Submission Method", "How to Apply", "Bid Submission Type", "Electronic Submission", "Paper Submission"),
        "The method by which the bid must be submitted, such as electronic, physical mail, or portal.",
    ),
    Field(
        5, "term_of_bid", "Term of Bid", "terms", "string", False,
        ("Term of Bid", "Length of Contract", "Initial Term", "Contract Duration", "Period of Performance"),
        "The duration or length of the contract resulting from this bid.",
    ),
    Field(
        6, "pre_bid_meeting", "Pre Bid Meeting", "schedule", "string", False,
        ("Prebid Conference", "Pre-proposal Meeting", "Site Visit", "Pre Bid Meeting"),
        "Information regarding any pre-bid conference, meeting, or site visit including date, time, and location.",
    ),
    Field(
        7, "installation", "Installation", "specifications", "string", False,
        ("Installation", "Setup Requirements", "Installation Required"),
        "Requirements or instructions regarding the installation of the product or service.",
    ),
    Field(
        8, "bid_bond_requirement", "Bid Bond Requirement", "terms", "string", False,
        ("Bid Bond", "Security Deposit", "Bond Requirement", "Guaranty"),
        "Requirements for a bid bond, security deposit, or financial guaranty to be submitted with the bid.",
    ),
    Field(
        9, "delivery_date", "Delivery Date", "schedule", "string", False,
        ("Delivery Date", "Delivery Timeframe", "Delivery Schedule", "Delivery within"),
        "The required or expected date or timeframe for delivery of the products or services.",
    ),
    Field(
        10, "payment_terms", "Payment Terms", "terms", "string", False,
        ("Payment Terms", "Invoicing Instructions", "Terms of Payment", "Net 30"),
        "The terms and conditions related to payment and invoicing.",
    ),
    Field(
        11, "additional_documentation", "Any Additional Documentation Required", "terms", "list", True,
        ("Additional Documentation", "Required Forms", "Affidavit", "Certifications Required", "Attachments", "Form", "completed, signed and attached"),
        "Any additional forms, affidavits, or documentation that must be submitted with the bid.",
    ),
    Field(
        12, "mfg_for_registration", "MFG for Registration", "products", "list", True,
        ("Manufacturer Name", "MFG for Registration", "Registration", "Manufacturer"),
        "The manufacturer name required for product registration or special pricing.",
    ),
    Field(
        13, "contract_or_cooperative", "Contract or Cooperative to use", "terms", "string", False,
        ("Cooperative", "Contract Vehicle", "State Contract", "Piggyback"),
        "The name of any specific cooperative purchasing agreement or state contract to be used.",
    ),
    Field(
        14, "model_no", "Model_no", "products", "list", True,
        ("Model Number", "Model_no", "Model"),
        "The specific model number of the requested product or equipment.",
    ),
    Field(
        15, "part_no", "Part_no", "products", "list", True,
        ("Part Number", "Part_no", "Part #", "SKU"),
        "The specific part number, SKU, or manufacturer part identifier for the requested product.",
    ),
    Field(
        16, "product", "Product", "products", "list", True,
        ("Product", "Item Description", "Commodity"),
        "The name or short description of the main product, item, or commodity being purchased.",
    ),
    Field(
        17, "contact_info", "contact_info", "contacts_summary", "contact", True,
        ("Contact Information", "Point of Contact", "Buyer Name", "Procurement Officer", "Purchasing Agent", "Email", "Phone"),
        "The name, email, and phone number of the main contact person, buyer, or procurement officer for this solicitation.",
    ),
    Field(
        18, "company_name", "company_name", "identity", "string", False,
        ("Issuing Organization", "Agency Name", "Department Name", "Company Name", "Issued By"),
        "The name of the agency, company, department, or organization issuing the solicitation.",
    ),
    Field(
        19, "bid_summary", "Bid Summary", "contacts_summary", "string", False,
        ("Bid Summary", "Scope of Work", "Executive Summary", "Description"),
        "A brief summary, description, or executive overview of what the solicitation is about and the scope of work.",
    ),
    Field(
        20, "product_specification", "Product Specification", "specifications", "string", True,
        ("Product Specification", "Specs", "Technical Requirements", "Minimum Specifications"),
        "The detailed technical specifications, requirements, and minimum standards for the requested product.",
    ),
)


def fields(group: str | None = None) -> list[Field]:
    """The fields in the order of the record; those of one group, none for an unknown one."""
    return [f for f in FIELDS if group in (None, f.group)]


def aliases(group: str) -> list[str]:
    """The different aliases of the fields of a group, in the order of the record."""
    return list(dict.fromkeys(a for f in fields(group) for a in f.aliases))


def field_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of 20 rows: position, field_name, label, field_group, kind, many, aliases, question."""
    text = T.StringType()
    schema = T.StructType([T.StructField("position", T.IntegerType()), *(T.StructField(n, text) for n in ("field_name", "label", "field_group", "kind"))])
    schema = schema.add("many", T.BooleanType()).add("aliases", T.ArrayType(text)).add("question", text)
    return spark.createDataFrame([(f.position, f.name, f.label, f.group, f.kind, f.many, list(f.aliases), f.question) for f in FIELDS], schema)
