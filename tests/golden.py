"""The published synthetic scenario, rebuilt from its description: 2 towers of 10 floors with 2 units each.

Fixed values: towers, typologies, areas, bands, factors, target and hash must be these for the published hash.
The rest (development, parameter set, override) is our own; the hash does not depend on it.
"""

HASH = "f065d10503bd9ca6480fc920baf3e5519ef4ef55036e95766574b80dfb49082f"


def scenario(**changes) -> dict:
    kinds = [("TYPE_A", "45.00", "0.00"), ("TYPE_B", "65.00", "5.00"), ("TYPE_C", "85.00", "10.00"), ("TYPE_D", "120.00", "20.00")]
    units = []
    for tower in ("TOWER-1", "TOWER-2"):
        for index in range(20):
            floor, slot = index // 2 + 1, index % 2 + 1
            units.append({
                "tower_business_key": tower, "typology_business_key": kinds[index % 4][0], "unit_code": f"{floor:02d}{slot:02d}",
                "floor": floor, "position_category": "ABCD"[index % 4],
            })
    found = {
        "development": {"business_key": "HILLSIDE", "name": "Hillside", "city": "C", "state": "RF", "bairro": "B", "total_floors": 10},
        "towers": [{"business_key": "TOWER-1", "name": "One"}, {"business_key": "TOWER-2", "name": "Two"}],
        "typologies": [{"business_key": k, "private_area_m2": a, "uncovered_area_m2": u} for k, a, u in kinds],
        "units": units,
        "floor_bands": {"LOW": [1, 3], "MID": [4, 7], "HIGH": [8, 10]},
        "parameter_set": {"code": "AREAS", "version": 3, "parameters": [
            {"key": "UNCOVERED_AREA_FACTOR", "value_type": "NUMERIC", "numeric_value": "0.40"}]},
        "calibration_sets": [
            {"code": "FLOOR_BAND", "dimension": "FLOOR", "entries": [
                {"category_key": k, "factor": f} for k, f in (("LOW", "1.00"), ("MID", "1.05"), ("HIGH", "1.10"))]},
            {"code": "POSITION_CATEGORY", "dimension": "POSITION", "entries": [
                {"category_key": k, "factor": f} for k, f in zip("ABCD", ("1.00", "1.02", "1.04", "1.06"))]},
        ],
        "vgv_target": {"target_value": "10000000.00", "origin": "MANUAL"},
        "override": {"run": "second", "target_unit_code": "0502", "target_tower_business_key": "TOWER-2", "reason": "view",
                     "override_delta": "-1234.56", "decided_at": "2025-02-03T04:05:06+00:00"},
    }
    found.update(changes)
    return found
