from datetime import datetime

import pytest

from quillspark.sources.workspace import of_tables, schema


def at(hour):
    return datetime(2026, 1, 5, hour)


@pytest.fixture(scope="session")
def ws(spark):
    """A small workspace with two vehicles, old notes and links that lead nowhere."""

    def table(name, rows):
        fields = schema(name)
        return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)

    base = {"vehicle_id": 1, "created_at": at(1), "updated_at": at(1)}
    documents = [
        {"id": 1, "title": "Thermostat replacement bulletin", "original_filename": "thermostat-bulletin.pdf", "system": "Cooling", "document_type": "Bulletin", "notes": "Check the thermostat first.", "extracted_text": "A stuck\n thermostat  overheats.", "extraction_status": "completed", "is_favorite": True},
        {"id": 2, "title": "Idle airflow diagram", "original_filename": "idle.pdf", "system": "Engine", "document_type": "Diagram", "extraction_status": "failed: x", "is_favorite": False, "updated_at": at(5)},
        {"id": 3, "title": "throttle cleaning checklist", "original_filename": "a_b\\c.pdf", "system": "Engine", "document_type": " ", "extraction_status": "not_attempted", "is_favorite": False},
        {"id": 4, "title": "À propos", "original_filename": "other.pdf", "system": "Brakes", "document_type": "Bulletin", "vehicle_id": 2, "is_favorite": True},
    ]
    symptoms = [
        {"id": 1, "title": "Idle surge after warm start", "system": "Engine", "confidence": "high", "status": "monitoring", "suspected_causes": "Dirty throttle body or vacuum leak", "notes": "Check the throttle plate", "updated_at": at(3)},
        {"id": 2, "title": "Rear brake squeak", "system": "Brakes", "confidence": "", "status": "open"},
        {"id": 3, "title": "Unknown", "status": "odd", "updated_at": at(2)},
        {"id": 4, "title": "Elsewhere throttle", "vehicle_id": 2},
    ]
    procedures = [
        {"id": 1, "title": "Clean the throttle body", "system": "Engine", "difficulty": "beginner", "parts_needed": "Throttle body cleaner", "steps": "Remove hose, spray cleaner, refit."},
        {"id": 2, "title": "Replace cabin air filter", "system": "HVAC", "safety_notes": "cleaner fumes"},
    ]
    notes = [
        {"id": 1, "title": "Wheel torque reminder", "content": "Torque to 76 ft-lb", "note_type": "reminder", "related_entity_type": "procedure", "related_entity_id": 1},
        {"id": 2, "title": "Wheel spec reference", "content": "", "body": "from body", "related_entity_type": "document", "related_entity_id": 2},
        {"id": 3, "title": "  ", "content": "old", "related_entity_type": " ", "document_id": 1},
        {"id": 4, "title": "case", "content": "x", "related_entity_type": "Document", "related_entity_id": 1},
        {"id": 5, "title": "gone", "content": "x", "related_entity_type": "symptom", "related_entity_id": 99},
        {"id": 6, "title": "free", "content": "x", "related_entity_type": "none", "document_id": 2},
    ]
    return of_tables(
        spark,
        vehicles=table("vehicles", [{"id": 1, "year": 2009, "make": "Volvo", "model": "V70", "trim": "LE", "engine": "1.8L"}, {"id": 2, "year": 2012, "make": "Ford", "model": "Focus"}]),
        app_settings=table("app_settings", [{"id": 1, "document_system_defaults": '["Engine", " engine ", 7, "Cooling"]', "document_type_defaults": "{broken"}]),
        documents=table("documents", [base | d for d in documents]),
        symptoms=table("symptoms", [base | s for s in symptoms]),
        procedures=table("procedures", [base | p for p in procedures]),
        notes=table("notes", [base | n for n in notes]),
        symptom_documents=table("symptom_documents", [{"symptom_id": 1, "document_id": d} for d in (2, 3, 2, 50)]),
        procedure_documents=table("procedure_documents", [{"procedure_id": 1, "document_id": 3}]),
    )
