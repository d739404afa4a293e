"""Which tables hold entities, and which columns refer to them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column

from kindred.functions import text

PENDING, EXECUTED, DISCARDED, REVERTED = 1, 2, 3, 4
STATUS = {PENDING: "Pendente", EXECUTED: "Executado", DISCARDED: "Descartado", REVERTED: "Revertido"}
CITY, DISTRICT, STREET, CONDO = 1, 2, 3, 4
TYPE_LABEL = {CITY: "Cidade", DISTRICT: "Bairro", STREET: "Logradouro", CONDO: "Condominio"}
TABLE_LABEL = {
    "bairro": "Bairros", "logradouro": "Logradouros", "condominio": "Condomínios", "cidade": "Cidades", "imovel": "Imóveis",
    "imovel_endereco": "Endereços de imóveis", "empresa": "Empresas", "pessoa": "Pessoas", "pessoa_fisica": "Pessoas físicas",
    "building": "Buildings", "building_address": "Endereços de building", "property_drafts": "Rascunhos de imóveis",
    "property_draft_addresses": "Endereços de rascunhos", "benfeitoria_condominio": "Benfeitorias de condomínio", "condominio_imagem": "Imagens de condomínio",
}


@dataclass(frozen=True)
class FkRef:
    """A column that refers to an entity. key: the columns that tell a row of the table from all others."""

    table: str
    column: str
    key: tuple[str, ...] = ("id",)


@dataclass(frozen=True)
class EntitySpec:
    """variants: the forms of a name whose best similarity counts; the first is the raw one."""

    name: str
    table: str
    code: int
    id_col: str = "id"
    name_col: str = "nome"
    block_col: str | None = None
    soft_delete: str | None = "excluido"
    variants: tuple[Callable[[Column], Column], ...] = (text.unaccent_lower,)
    kind: str | None = None
    refs: Sequence[FkRef] = field(default_factory=tuple)


def short_numerals(c: Column) -> Column:
    return text.numerals(text.clean_condo(c), text.SHORT_NUMERALS)


PLACES = {
    CITY: EntitySpec("cidade", "cidade", CITY, block_col="estado_id", soft_delete=None, refs=(FkRef("bairro", "cidade_id"), FkRef("empresa", "cidade_id"), FkRef("pessoa_fisica", "naturalidade_id", ("pessoa_id",)))),
    DISTRICT: EntitySpec("bairro", "bairro", DISTRICT, block_col="cidade_id", variants=(text.unaccent_lower, text.clean_district), kind=text.DISTRICT, refs=(FkRef("logradouro", "bairro_id"), FkRef("imovel_endereco", "bairro_comercial_id", ("imovel_id",)), FkRef("empresa", "bairro_id"), FkRef("property_draft_addresses", "bairro_comercial_id"))),
    STREET: EntitySpec("logradouro", "logradouro", STREET, block_col="bairro_id", refs=(FkRef("imovel", "logradouro_id"), FkRef("condominio", "logradouro_id"), FkRef("pessoa", "endereco_logradouro_id"), FkRef("building_address", "logradouro_id"), FkRef("property_drafts", "logradouro_id"))),
    CONDO: EntitySpec("condominio", "condominio", CONDO, block_col="bairro_id", variants=(text.unaccent_lower, text.clean_condo, short_numerals), kind=text.CONDO, refs=(FkRef("imovel_endereco", "condominio_id", ("imovel_id",)), FkRef("pessoa", "condominio_id"), FkRef("building", "condominio_id"), FkRef("benfeitoria_condominio", "condominios_id", ("benfeitorias_id", "condominios_id")), FkRef("condominio_imagem", "condominio_id"), FkRef("property_draft_addresses", "condominio_id"))),
}

#: The driver's tables in the same roles.
PART = EntitySpec("part", "part", 14, "p_partkey", "p_name", "p_brand", None, refs=(FkRef("lineitem", "l_partkey", ("l_orderkey", "l_linenumber")),))
CUSTOMER = EntitySpec("customer", "customer", 12, "c_custkey", "c_name", "c_nationkey", None, refs=(FkRef("orders", "o_custkey", ("o_orderkey",)),))
SUPPLIER = EntitySpec("supplier", "supplier", 13, "s_suppkey", "s_name", "s_nationkey", None, refs=(FkRef("lineitem", "l_suppkey", ("l_orderkey", "l_linenumber")),))
NATION = EntitySpec("nation", "nation", 11, "n_nationkey", "n_name", "n_regionkey", None, refs=(FkRef("customer", "c_nationkey", ("c_custkey",)), FkRef("supplier", "s_nationkey", ("s_suppkey",))))
