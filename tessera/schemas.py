"""Schemas of project tables; nothing is inferred."""

IMAGES = "project_id string, img_nr int, filename string, width int, height int, projection int, hfov double, ev double, roll double, pitch double, yaw double, dist array<double>, vig_mode int, vig_coeff array<double>, crop array<int>, links map<string, int>"
CONTROL_POINTS = "project_id string, cp_id long, img1 int, img2 int, x1 double, y1 double, x2 double, y2 double, mode int"
MASKS = "project_id string, img_nr int, mask_type int, poly array<struct<x: double, y: double>>"
OPTIONS = "project_id string, name string, value string"
KEYPOINTS = "img_nr int, kp_id long, x double, y double, scale double, orientation double, score double, vec array<double>"
PHOTO_PAIRS = "img1 int, img2 int, x1 double, y1 double, x2 double, y2 double, r1r float, r1g float, r1b float, r2r float, r2g float, r2b float, idx double, rad1 float, rad2 float, edge double"

#: Lens tables: columns and key. The version goes with them (a table of one row), so that a reader can refuse a newer one.
LENS_VERSION = 1
LENS = {
    "camera_crop": ("maker string, model string, cropfactor double", ["maker", "model"]),
    "lens_projection": ("lens string, projection int", ["lens"]),
    "lens_hfov": ("lens string, focallength double, hfov double, weight int", ["lens", "focallength"]),
    "lens_crop": ("lens string, focallength double, width int, height int, cropleft int, cropright int, croptop int, cropbottom int", ["lens", "focallength", "width", "height"]),
    "distortion": ("lens string, focallength double, a double, b double, c double, weight int", ["lens", "focallength"]),
    "vignetting": ("lens string, focallength double, aperture double, distance double, vb double, vc double, vd double, weight int", ["lens", "focallength", "aperture", "distance"]),
    "emor": ("maker string, model string, iso int, ra double, rb double, rc double, rd double, re double, weight int", ["maker", "model"]),
    "tca": ("lens string, focallength double, ra double, rb double, rc double, rd double, ba double, bb double, bc double, bd double, weight int", ["lens", "focallength"]),
}
