"""Schemas of the records that the engine reads and writes."""

EMAIL = (
    "message_id string, from_addr string, to_addrs array<string>, cc_addrs array<string>, subject string, date string, body string, "
    "x_folder string, x_origin string, in_reply_to string, references array<string>, x_from_display string, x_to_display string, x_cc_display string"
)

_LISTS = (
    "people array<struct<name:string,email:string,role_or_title:string>>, "
    "organizations array<struct<name:string,org_type:string>>, "
    "deals array<struct<name:string,description:string,parties_involved:array<string>>>, "
    "decisions array<struct<description:string,made_by:string,affects:array<string>>>, "
    "relationships array<struct<person_a:string,person_b:string,relationship_type:string,evidence:string>>"
)
MODEL_OUTPUT = _LISTS
EXTRACTION = f"message_id string, prompt_version string, model_name string, {_LISTS}"

# Fixed values
FIELDS = ("people", "organizations", "deals", "decisions", "relationships")
RELATIONSHIP_TYPES = ("reports_to", "works_with", "requests_from", "negotiating_with", "informs")
