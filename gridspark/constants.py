"""Addresses of services and catalogues."""

RCMED_QUERY_URL = "http://rcmes.jpl.nasa.gov/query-api/query.php?"

ESGF_NODES = {
    "LLNL": "esgf-node.llnl.gov",
    "JPL": "esgf-node.jpl.nasa.gov",
    "CEDA": "esgf-index1.ceda.ac.uk",
    "DKRZ": "esgf-data.dkrz.de",
    "LIU": "esg-dn1.nsc.liu.se",
    "IPSL": "esgf-node.ipsl.upmc.fr",
    "NCI": "esgf.nci.org.au",
    "GFDL": "esgdata.gfdl.noaa.gov",
    "GSFC": "esgf.nccs.nasa.gov",
}

DEFAULT_INTAKE_CAT = "https://raw.githubusercontent.com/pangeo-data/pangeo-datastore/master/intake-catalogs/master.yaml"
DEFAULT_INTAKE_ESM_CAT = "https://raw.githubusercontent.com/NCAR/intake-esm-datastore/master/catalogs/pangeo-cmip6.json"
