"""A small model of a harbour for tests of model files, targets, importers and queries' lint."""

HARBOUR = """
namespace: { prefix: hb, iri: "https://example.org/harbour#" }
mixins:
  Surveyed: { id: m_sur, props: { surveyedOn: { id: p_sur, type: date } } }
enums:
  Flag: { id: x_flag, values: [malta, oslo, panama] }
nodes:
  Craft: { id: n_craft, abstract: true }
  Ship: { id: n_ship, extends: Craft, key: [imo], props: { imo: { id: p_imo, type: int, required: true }, callSign: { id: p_call, type: string, unique: true }, flag: { id: p_flag, type: string, enum: Flag }, draught: { id: p_dra, type: float, min: 0, max: 25 } } }
  Place: { id: n_place, abstract: true, key: [code], props: { code: { id: p_code, type: string, required: true } } }
  Berth: { id: n_berth, extends: Place, mixins: [Surveyed], props: { metres: { id: p_met, type: int } } }
  Yard: { id: n_yard, extends: Place, props: { owner: { id: p_own, type: string } } }
edges:
  CALLS_AT: { id: e_call, from: Ship, to: Place, cardinality: many-to-one, props: { eta: { id: p_eta, type: date } } }
  TOWS: { id: e_tow, from: Ship, to: Ship }
"""
